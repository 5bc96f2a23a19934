"""Common letter pairs and triples by language. All are fixed values."""

from __future__ import annotations

# Pairs of letters.
BIGRAMS = {
    "en": """
an ar er in on or en at ed es ha he hi is it le me nd ne ng nt ou re se st te th to ve wa al as be ca ch co de
di do ea el et fo ge ho ia ic id ie il io ke la li lo ly ma mi mo na no ny of ol om oo op os ot ow pa pe po pr
ra ri ro ry sa sh si so ta ti tr ty ur us ut we ll ss tt ff pp mm nn cc dd gg
""".split(),
    "es": """
ez ia io os as es is en on an ar er or al el il ol ul az iz gu qu ch rr ll ci ce gi ge ue ie ua ja jo ju za zo
na no ma mo la lo ra ro sa so ta to da do ca co ba bo pa po nd nt rt rd rc rm rn rs nc nz
""".split(),
    "fr": """
au ou eu oi ai ei ui ue on an en in un om am em im ch ph th qu gn il ot et at ut it el al ol ul le la re ra te
ta de da ne na me ma se sa ce ca pe pa be ba er ar or ir ur es as os is us
""".split(),
    "de": """
ch ck tz pf ng nk ig ae oe ue ss ei ie eu au ai ui oi st sp sk kr gr br fr tr dr pr kl gl bl fl pl wr zw er en
el em es et an in on un ar ir or ur nd nt rt
""".split(),
    "it": """
gn sc zz tt ll rr cc gg io ia ie ii uo ua ue ui ao ai ae eo ea ee ei oo oa oe oi ca co cu ga go gu ci ce gi ge
si se sa so su no na ni ne ro ra ri re to ta ti te an en in on un ar er ir or ur al el il ol ul as es is os us
""".split(),
    "pt": """
nh lh ch gu qu ao oe ae eo io ui ei ai au ou an en in on un am em im om um es as os is us ez az iz oz uz ar er
ir or ur al el il ol ul va ve vi vo vu za ze zi zo zu ca co cu ce ci ga go ge gi na ne ni no nu ma me mi mo mu
ra re ri ro ru sa se si so su
""".split(),
    "romanized": """
ov ev sh zh kh ts ch ya yu ye yo ii yy qi xi zi ci si ri an en in un ai ei ui ao ou iu ie ue er ka ki ku ke ko
sa su se so ta te to na ni nu ne no ha hi fu he ho ma mi mu me mo ra ru re ro wa wo ga gi gu ge go za ji zu ze
zo da de do ba bi bu be bo pa pi pu pe po eo ae oe gw kw hw ng nk nh al el il ul ah eh ih uh gh dh th ug ph tr
qu uy oa oi
""".split(),
    "universal": """
an en in on un ar er ir or ur al el il ol ul as es is os us na ne ni no nu ma me mi mo mu ra re ri ro ru sa se
si so su ta te ti to tu la le li lo lu
""".split(),
}

# Triples of letters.
TRIGRAMS = {
    "en": """
the and ing ion tio ent for her ter res ate ver all wit are est ste ati tur int son sen man ton ley lyn ann
een ine ell
""".split(),
    "es": """
cia ion ado ida ido ero era oso osa and ent ant est ist ort art der del los las nez lez rez dez vez gue que
qui cio
""".split(),
    "fr": """
ion ent ait ais ant eur eau aux oux eux que qui ois ons ont int ier oir eil ill
""".split(),
    "de": """
sch ich ein und ung eit cht ber ste ter der den man ann ern ert ers ens elt eld str erg
""".split(),
    "it": """
ett ino ina oni ano ane ato ata ito ita uti ute ali ale ell lla llo cci ggi ghi chi zza zze zzi zzo gli
""".split(),
    "pt": """
cao sao oes aes ios ias dos das nte nde ado ida ido oso osa eir inh nho nha vez lez rez dez nez lho lha
""".split(),
    "romanized": """
ski sky ova eva yan ian ovi vic ich nko enk ska vna yev shi chi zhi ang eng ing ong ung iao uai uan ama aka
ima ika uma uka oya oki ura awa ata asa ari ani umi ino kim oon hin hoi abd abu ibn bin ahm med hma man wan
adi sri utr tra put raj mar esh ish dha bha sha
""".split(),
    "universal": """
ana ane ani ano anu ena ene eni eno enu ina ine ini ino inu ona one oni ono onu una une uni uno unu ara are
ari aro aru
""".split(),
}

# Pairs and triples of the English-only mode.
ENGLISH_BIGRAMS = """
an ar er in on or en at ed es ha he hi is it le me nd ne ng nt ou re se st te th to ve wa al as be ca ch co de
di do ea el et fo ge ho ia ic id ie il io ke la li lo ly ma mi mo na no ny of ol om oo op os ot ow pa pe po pr
ra ri ro ry sa sh si so ta ti tr ty ur us ut we ll ss tt ff pp mm nn cc dd gg
""".split()
ENGLISH_TRIGRAMS = """
the and ing ion tio ent for her ter res ate ver all wit are est ste ati tur int nte iti con ted ers pro thi
tin hen ain eve ome ere ect one ith rea cal man ist ant ire ill ous men sta lat ear our eri
""".split()
