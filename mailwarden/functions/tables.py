"""Lookup tables with the values that scores depend on. All are fixed values."""

from __future__ import annotations

# Tld, category, share of disposable mail, share of spam, risk multiplier, registration cost, description.
TLD_PROFILES = """
edu trusted 0.01 0.02 0.5 restricted Educational institutions only (US)
gov trusted 0.00 0.01 0.3 restricted US government only
mil trusted 0.00 0.00 0.2 restricted US military only
com standard 0.05 0.10 1.0 medium Commercial - most common
net standard 0.08 0.12 1.1 medium Network infrastructure
org standard 0.03 0.05 0.8 medium Organizations
info standard 0.15 0.20 1.3 low Information services
biz standard 0.12 0.18 1.2 medium Business
uk standard 0.04 0.06 0.9 medium United Kingdom
de standard 0.03 0.05 0.8 low Germany
fr standard 0.04 0.06 0.9 medium France
ca standard 0.02 0.04 0.7 medium Canada
au standard 0.03 0.05 0.8 medium Australia
xyz suspicious 0.45 0.60 2.5 low Generic - high abuse rate
top suspicious 0.50 0.65 2.7 low Generic - high spam rate
site suspicious 0.40 0.55 2.3 low Generic websites
online suspicious 0.35 0.50 2.1 low Generic online services
club suspicious 0.38 0.52 2.2 low Clubs and communities
tk high_risk 0.70 0.80 3.0 free Tokelau - free registration, very high abuse
ml high_risk 0.65 0.75 2.8 free Mali - free registration, high abuse
ga high_risk 0.60 0.70 2.6 free Gabon - free registration, high abuse
cf high_risk 0.62 0.72 2.7 free Central African Republic - free, high abuse
gq high_risk 0.58 0.68 2.5 free Equatorial Guinea - free, high abuse
email suspicious 0.30 0.45 1.9 medium Email-specific TLD
tech standard 0.10 0.15 1.1 medium Technology sector
app standard 0.08 0.12 1.0 medium Applications
dev standard 0.06 0.10 0.9 medium Developers
io standard 0.09 0.13 1.0 high Tech startups
ru high_risk 0.55 0.65 2.4 low Russia - historically high spam/phishing rates
cn high_risk 0.50 0.60 2.3 low China - high spam rates
pw high_risk 0.60 0.70 2.6 low Palau - cheap, high abuse
cc high_risk 0.52 0.62 2.3 low Cocos Islands - popular with spammers
ws high_risk 0.48 0.58 2.2 low Samoa - cheap, moderate abuse
gdn high_risk 0.55 0.65 2.4 free Generic - free, high abuse
mom high_risk 0.45 0.55 2.1 low Generic - cheap, moderate abuse
icu high_risk 0.58 0.68 2.5 low Generic - cheap, very high abuse
buzz high_risk 0.42 0.52 2.0 low Generic - cheap, moderate abuse
click suspicious 0.48 0.60 2.4 low Generic - cheap, high clickbait/spam abuse
download suspicious 0.52 0.65 2.5 low Generic - malware distribution risk
loan suspicious 0.55 0.70 2.6 low Generic - financial scam magnet
win suspicious 0.50 0.62 2.4 low Generic - sweepstakes scams
bid suspicious 0.47 0.58 2.3 low Generic - auction scams
racing suspicious 0.40 0.50 2.0 low Generic - gambling/betting abuse
review suspicious 0.38 0.48 1.9 low Generic - fake review sites
party suspicious 0.42 0.53 2.1 low Generic - spam/adult content
trade suspicious 0.44 0.55 2.2 low Generic - trading scams
webcam suspicious 0.45 0.57 2.2 low Generic - adult content spam
date suspicious 0.43 0.54 2.1 low Generic - dating scams
science suspicious 0.35 0.45 1.8 low Generic - often misused for spam
stream suspicious 0.38 0.48 1.9 medium Generic - piracy/spam
accountant suspicious 0.36 0.46 1.8 low Generic - financial scam target
faith suspicious 0.34 0.44 1.7 low Generic - religious scams
cricket suspicious 0.32 0.42 1.6 medium Generic - betting scams
men suspicious 0.40 0.50 2.0 low Generic - adult content
link suspicious 0.42 0.53 2.1 low Generic - URL shortening abuse
live suspicious 0.35 0.45 1.8 medium Generic - streaming spam
work suspicious 0.30 0.40 1.6 medium Generic - employment scams
jp standard 0.02 0.04 0.7 medium Japan - regulated, low abuse
kr standard 0.03 0.05 0.8 medium South Korea - regulated
sg standard 0.02 0.04 0.7 medium Singapore - business hub, low abuse
hk standard 0.04 0.06 0.9 medium Hong Kong - financial center
tw standard 0.05 0.07 0.9 medium Taiwan - moderate abuse
in standard 0.08 0.12 1.1 low India - large market, moderate abuse
id standard 0.10 0.15 1.2 low Indonesia - growing market
th standard 0.07 0.10 1.0 medium Thailand
my standard 0.06 0.09 0.9 medium Malaysia
ph standard 0.09 0.13 1.1 medium Philippines
vn standard 0.08 0.12 1.0 medium Vietnam
nz standard 0.03 0.05 0.8 medium New Zealand - regulated, low abuse
br standard 0.10 0.15 1.2 low Brazil - large market
mx standard 0.08 0.12 1.1 medium Mexico
ar standard 0.09 0.13 1.1 medium Argentina
cl standard 0.06 0.09 0.9 medium Chile
co standard 0.12 0.18 1.3 medium Colombia - also used as .com alternative
pe standard 0.07 0.10 1.0 medium Peru
ve standard 0.11 0.16 1.2 medium Venezuela
es standard 0.05 0.08 0.9 low Spain
it standard 0.06 0.09 0.9 medium Italy
nl standard 0.03 0.05 0.8 medium Netherlands - business friendly
se standard 0.02 0.04 0.7 medium Sweden - regulated, low abuse
no standard 0.02 0.04 0.7 medium Norway - regulated, low abuse
fi standard 0.02 0.04 0.7 medium Finland - regulated, low abuse
dk standard 0.03 0.05 0.8 medium Denmark - regulated
pl standard 0.07 0.10 1.0 low Poland
ch standard 0.02 0.03 0.6 medium Switzerland - financial center, very low abuse
at standard 0.03 0.05 0.8 medium Austria
be standard 0.04 0.06 0.8 medium Belgium
pt standard 0.05 0.08 0.9 medium Portugal
gr standard 0.06 0.09 0.9 medium Greece
cz standard 0.05 0.08 0.9 low Czech Republic
ro standard 0.08 0.12 1.1 low Romania
hu standard 0.06 0.09 0.9 medium Hungary
za standard 0.07 0.10 1.0 medium South Africa
ae standard 0.05 0.08 0.9 high UAE - business hub
il standard 0.04 0.07 0.8 medium Israel - tech hub
tr standard 0.10 0.15 1.2 medium Turkey
store standard 0.12 0.18 1.2 medium E-commerce - moderate risk
shop standard 0.10 0.15 1.1 medium E-commerce
blog standard 0.08 0.12 1.0 medium Blogging platforms
news standard 0.07 0.10 0.9 high News organizations
media standard 0.09 0.13 1.0 medium Media companies
digital standard 0.08 0.12 1.0 medium Digital businesses
services standard 0.10 0.14 1.1 medium Service providers
solutions standard 0.09 0.13 1.0 medium Business solutions
business standard 0.08 0.12 1.0 medium General business
company standard 0.09 0.13 1.0 medium Corporations
pro standard 0.07 0.10 0.9 medium Professionals - verified
tools standard 0.10 0.14 1.1 medium Tool/software vendors
network standard 0.11 0.16 1.2 medium Network services
systems standard 0.10 0.14 1.1 medium System integrators
center standard 0.09 0.13 1.0 medium Service centers
support standard 0.11 0.16 1.2 medium Support services
consulting standard 0.06 0.09 0.9 medium Consultants
marketing standard 0.10 0.15 1.1 medium Marketing agencies
finance standard 0.12 0.18 1.3 high Financial services - scam target
legal standard 0.05 0.08 0.8 high Legal professionals
health standard 0.08 0.12 1.0 high Healthcare
fitness standard 0.10 0.15 1.1 medium Fitness industry
design standard 0.07 0.10 0.9 medium Designers
art standard 0.08 0.12 1.0 medium Artists
photography standard 0.06 0.09 0.9 medium Photographers
music standard 0.09 0.13 1.0 high Music industry
video standard 0.11 0.16 1.2 medium Video content
games standard 0.12 0.18 1.3 medium Gaming - moderate risk
travel standard 0.10 0.15 1.2 high Travel industry
hotel standard 0.09 0.13 1.1 high Hotels
restaurant standard 0.07 0.10 0.9 medium Restaurants
food standard 0.08 0.12 1.0 medium Food industry
plus standard 0.09 0.13 1.0 medium Premium services
agency standard 0.10 0.14 1.1 medium Agencies
academy standard 0.07 0.10 0.9 medium Educational institutions
education standard 0.06 0.09 0.9 medium Education sector
university standard 0.04 0.07 0.8 high Universities
school standard 0.05 0.08 0.8 medium Schools
today standard 0.11 0.16 1.2 low General purpose
world standard 0.10 0.15 1.1 medium Global services
life standard 0.12 0.18 1.2 medium Lifestyle
style standard 0.10 0.15 1.1 medium Fashion/lifestyle
money suspicious 0.35 0.45 1.9 medium Financial - scam magnet
cash suspicious 0.38 0.48 2.0 medium Financial - high scam risk
cheap suspicious 0.40 0.50 2.0 low Discount scams
free suspicious 0.45 0.55 2.2 low Free offers - scam magnet
"""

# Domains of disposable mail; a fuller list is a parameter of the functions that use it.
DISPOSABLE = """
10minutemail.com 10minutemail.net 10minutemail.org 20minutemail.com 30minutemail.com guerrillamail.com
guerrillamail.net guerrillamail.org guerrillamailblock.com mailinator.com mailinator.net mailinator2.com
maildrop.cc tempmail.com temp-mail.org temp-mail.io temp-mail.de throwaway.email throwawaymail.com yopmail.com
yopmail.net yopmail.fr getnada.com fakeinbox.com fakeinbox.net fakemail.net trashmail.com trashmail.net
tempinbox.com minutemail.com sharklasers.com spamgourmet.com spam4.me spambox.us dispostable.com
emailondeck.com mytemp.email mohmal.com mailnesia.com mailcatch.com mailinater.com mailtemporaire.fr
mytrashmail.com anonbox.net incognitomail.com incognitomail.org burnermail.io anonymousemail.me hidemail.de
jetable.org disposable.com disposemail.com discard.email discardmail.com mintemail.com getairmail.com
airmail.cc mailnator.com emailtemporaire.fr crazymailing.com spambog.com spambog.de spambog.ru mailforspam.com
mailmetrash.com notmailinator.com trashmail.ws trashmail.de trashinbox.net throwam.com wegwerfmail.de
wegwerfemail.de trashmail.fr yopmail.gq correotemporal.org correo-temporal.com grr.la guerrillamail.biz
guerrillamail.de guerrillamail.info mailinator.us mailinator.info mailinator.org mailinator.biz sofimail.com
zippymail.info bobmail.info tempmail.dev tempmail.plus internxt.com tmail.ws tmailor.com tmpmail.org
tmpmail.net temp.email tempemailaddress.com temporaryemail.net temporaryemail.us temporaryinbox.com
instant-mail.de luxusmail.org maildax.com mailsac.com mailexpire.com email-fake.com emailfake.ml
fakeemailgenerator.com fakemailgenerator.com generator.email inboxbear.com binkmail.com emkei.com
receivemail.org eyepaste.com meltmail.com moakt.com mt2015.com tempsky.com tempr.email dropmail.me
leeching.net clipmail.eu amail4.me armyspy.com cuvox.de dayrep.com einrot.com fleckens.hu gustr.com
jourrapide.com rhyta.com superrito.com teleworm.us anonaddy.com simplelogin.com 33mail.com sms.sellaite.com
receive-smss.com receivesmsonline.com example.net example.org test.com testing.com teste.com temp.com
gmial.com gmai.com yahooo.com hotmial.com
""".split()

# Free mail providers.
FREE_PROVIDERS = """
gmail.com yahoo.com hotmail.com outlook.com live.com msn.com icloud.com me.com mac.com aol.com protonmail.com
proton.me mail.com gmx.com gmx.net zoho.com yandex.com mail.ru
""".split()

# Mail exchangers of well-known domains: domain, preference, exchange, ttl.
KNOWN_MX = """
gmail.com 5 gmail-smtp-in.l.google.com 3600
gmail.com 10 alt1.gmail-smtp-in.l.google.com 3600
gmail.com 20 alt2.gmail-smtp-in.l.google.com 3600
gmail.com 30 alt3.gmail-smtp-in.l.google.com 3600
gmail.com 40 alt4.gmail-smtp-in.l.google.com 3600
googlemail.com 5 gmail-smtp-in.l.google.com 3600
googlemail.com 10 alt1.gmail-smtp-in.l.google.com 3600
googlemail.com 20 alt2.gmail-smtp-in.l.google.com 3600
googlemail.com 30 alt3.gmail-smtp-in.l.google.com 3600
googlemail.com 40 alt4.gmail-smtp-in.l.google.com 3600
outlook.com 10 outlook-com.olc.protection.outlook.com 3600
hotmail.com 10 hotmail-com.olc.protection.outlook.com 3600
live.com 10 live-com.olc.protection.outlook.com 3600
msn.com 10 msn-com.olc.protection.outlook.com 3600
yahoo.com 1 mta5.am0.yahoodns.net 3600
yahoo.com 1 mta6.am0.yahoodns.net 3600
yahoo.com 1 mta7.am0.yahoodns.net 3600
ymail.com 1 mta5.am0.yahoodns.net 3600
ymail.com 1 mta6.am0.yahoodns.net 3600
ymail.com 1 mta7.am0.yahoodns.net 3600
icloud.com 10 mx01.mail.icloud.com 3600
icloud.com 10 mx02.mail.icloud.com 3600
me.com 10 mx01.mail.icloud.com 3600
me.com 10 mx02.mail.icloud.com 3600
mac.com 10 mx01.mail.icloud.com 3600
mac.com 10 mx02.mail.icloud.com 3600
protonmail.com 10 mail.protonmail.ch 3600
protonmail.com 20 mailsec.protonmail.ch 3600
proton.me 10 mail.protonmail.ch 3600
proton.me 20 mailsec.protonmail.ch 3600
aol.com 10 mx-aol.mail.gm0.yahoodns.net 3600
zoho.com 10 mx.zoho.com 3600
zoho.com 20 mx2.zoho.com 3600
zoho.com 50 mx3.zoho.com 3600
mail.com 10 mx00.mail.com 3600
mail.com 10 mx01.mail.com 3600
gmx.com 10 mx00.gmx.com 3600
gmx.com 20 mx01.gmx.com 3600
gmx.net 10 mx00.gmx.net 3600
gmx.net 20 mx01.gmx.net 3600
fastmail.com 10 in1-smtp.messagingengine.com 3600
fastmail.com 20 in2-smtp.messagingengine.com 3600
"""
