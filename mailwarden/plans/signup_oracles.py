"""SQL for DuckDB that states the sign-up queries anew, with its own list functions and RE2 patterns."""

from __future__ import annotations

from ..functions import tables
from ..functions.grams import BIGRAMS, ENGLISH_BIGRAMS, ENGLISH_TRIGRAMS, TRIGRAMS
from ..operators.features import FEATURES
from ..operators.synthetic import SUBSTITUTIONS, TLD_MISTAKES
from ..operators.training import POISSON
from ..sources.fixtures import WITH_SIGNUPS, WITH_VALIDATIONS
from .signup_queries import BETWEEN, DATES, DIRTY, NAMES, ODD, YEAR

RULES = (
    ("risk_score", ((0.9, 0.98, "heuristic_tld_extreme"), (0.8, 0.66, "heuristic_tld_high"))), ("id % 100 / 100", ((0.95, 0.96, "heuristic_domain_reputation_critical"), (0.85, 0.64, "heuristic_domain_reputation_watch"))),
    ("id % 50 / 50", ((0.98, 0.93, "heuristic_sequence_numeric_extreme"), (0.9, 0.61, "heuristic_sequence_numeric_high"))), ("id % 33 / 33", ((0.9, 0.93, "heuristic_digit_ratio_extreme"), (0.8, 0.61, "heuristic_digit_ratio_high"))),
    ("id % 10 / 10", ((0.8, 0.91, "heuristic_plus_tag_abuse"),)))

BASE = f"{WITH_SIGNUPS}, s AS (SELECT *, lower(trim(email)) AS e, split_part(lower(trim(email)), '@', 1) AS l, split_part(lower(trim(email)), '@', 2) AS d FROM signups)"


def _q(body: str, base: str = BASE) -> str:
    return f"{base} {body}"


def _draw(seed: str, *keys: str) -> str:
    return f"CAST('0x' || substr(md5('{seed}' || {' || '.join(f"'|' || CAST({k} AS VARCHAR)" for k in keys)}), 1, 15) AS BIGINT)"


def _list(items) -> str:
    return "[" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + "]"


def _in(items) -> str:
    return "(" + ", ".join(f"'{i}'" for i in items) + ")"


def _entropy(items: str) -> str:
    return f"coalesce(list_sum([-c / len({items}) * log2(c / len({items})) for c in [CAST(len([y for y in {items} if y = x]) AS DOUBLE) for x in list_distinct({items})]]), 0.0)"


PAIRS = "[substr(l, i, 2) for i in range(1, len(l))]"
DISPOSABLE_PATTERN = "temp.*mail|trash.*mail|fake.*mail|throw.*away|disposable|guerrilla|mailinator|[0-9]+minute.*mail|yopmail|maildrop|spam[0-9]+"
SUSPICIOUS = "^[0-9]+$|test|spam|temp|fake|trash|junk|disposable|throwaway|burner|trial"
DOTLESS = "CASE WHEN d IN ('gmail.com', 'googlemail.com') THEN replace(split_part(l, '+', 1), '.', '') ELSE split_part(l, '+', 1) END"
CANONICAL = f"{DOTLESS} || '@' || d"
TAG = "CASE WHEN contains(l, '+') THEN substr(l, instr(l, '+') + 1) END"

# P1 and P2 of local part l
SEQ = f"""
, q1 AS (SELECT *, regexp_extract(l, '^(.+?)([0-9]+)$', 1) AS b, regexp_extract(l, '^(.+?)([0-9]+)$', 2) AS m FROM s),
q2 AS (SELECT *, len(m) AS nm, len(m) > 1 AND m[1] = '0' AS z,
  regexp_matches(b, 'test|user|account|email|temp|demo|admin|guest|trial|sample|hello|service|team|info|support|member') AS common,
  len([y for y in [CAST(substr(m, i, 4) AS INT) for i in range(1, greatest(len(m) - 2, 1))] if len(m) >= 4 AND y BETWEEN greatest(1940, {YEAR} - 100) AND {YEAR} - 13]) > 0 AS birth FROM q1),
seq AS (SELECT *, CASE WHEN len(l) >= 2 AND nm > 0 AND NOT birth AND NOT (nm <= 3 AND len(b) >= 4 AND NOT z AND NOT common) THEN least(1.0,
  CAST(CASE nm WHEN 1 THEN 0.25 WHEN 2 THEN 0.35 WHEN 3 THEN 0.5 ELSE 0.7 END AS DOUBLE) + CASE WHEN z THEN 0.3 ELSE 0 END + CASE WHEN nm / len(l) > 0.5 THEN 0.2 WHEN nm / len(l) > 0.3 THEN 0.1 ELSE 0 END
  + CASE WHEN len(b) = 1 AND nm >= 2 THEN 0.2 ELSE 0 END + CASE WHEN common THEN 0.25 ELSE 0 END + CASE WHEN common AND nm <= 2 THEN 0.1 ELSE 0 END) ELSE 0.0 END AS c FROM q2)"""
# No derived local part has a number between separators, so the second pattern has no part in this.

# P7 of a text
NAMELIKE = "(regexp_full_match({0}, '[a-z]{{2,15}}') AND {0} NOT IN ('test', 'temp', 'fake', 'spam', 'admin', 'root', 'demo', 'trial', 'sample', 'example', 'null', 'void'))"


def _structure(t: str) -> str:
    return (f"CASE WHEN NOT regexp_matches({t}, '[._-]') THEN CASE WHEN len({t}) <= 4 THEN 'SHORT' WHEN {NAMELIKE.format(t)} THEN 'NAME' ELSE 'WORD' END ELSE array_to_string([CASE WHEN regexp_full_match(x, '[0-9]+') THEN 'NUM' "
            f"WHEN {NAMELIKE.format('x')} THEN 'NAME' WHEN len(x) <= 3 THEN 'SHORT' ELSE 'WORD' END for x in regexp_split_to_array({t}, '[._-]')], '.') END")


# P3 of local part l
M = "jan|january|feb|february|mar|march|apr|april|may|jun|june|jul|july|aug|august|sep|sept|september|oct|october|nov|november|dec|december"
Y = "(20[0-9][0-9]|19[0-9][0-9])"
R_FULL, R_MY, R_Y, R_LEAD, R_SHORT = f"^(.+?)[._-]?{Y}[._-]?([0-9][0-9])[._-]?([0-9][0-9])([._-].+)?$", f"^(.+?)[._-]?({M}|[0-9][0-9]){Y}([._-].+)?$", f"^(.+?)[._-]?{Y}([._-].+)?$", f"^{Y}[._-](.+)$", "^(.+?)[._-]?([0-9][0-9])$"


def _x(pattern: str, n: int) -> str:
    return f"regexp_extract(l, '{pattern}', {n})"


def _framed(pattern: str, n: int, token: str) -> str:
    return f"CASE WHEN {_x(pattern, n)} <> '' THEN {_x(pattern, 1)} || '.[{token}].' || substr({_x(pattern, n)}, 2) ELSE {_x(pattern, 1)} END"


DATED = f"""
, k1 AS (SELECT *, CASE WHEN len(l) < 4 THEN 'none'
  WHEN regexp_matches(l, '{R_FULL}') AND TRY_CAST({_x(R_FULL, 3)} AS INT) BETWEEN 1 AND 12 AND TRY_CAST({_x(R_FULL, 4)} AS INT) BETWEEN 1 AND 31 THEN 'full-date'
  WHEN regexp_matches(l, '{R_MY}') THEN 'month-year' WHEN regexp_matches(l, '{R_Y}') THEN 'year' WHEN regexp_matches(l, '{R_LEAD}') THEN 'leading'
  WHEN regexp_matches(l, '{R_SHORT}') AND len({_x(R_SHORT, 1)}) >= 4 THEN 'short-year' ELSE 'none' END AS k FROM s),
k2 AS (SELECT *, TRY_CAST(CASE k WHEN 'full-date' THEN {_x(R_FULL, 2)} WHEN 'month-year' THEN {_x(R_MY, 3)} WHEN 'year' THEN {_x(R_Y, 2)} WHEN 'leading' THEN {_x(R_LEAD, 1)}
    WHEN 'short-year' THEN CASE WHEN {_x(R_SHORT, 2)} <= '40' THEN '20' ELSE '19' END || {_x(R_SHORT, 2)} END AS INT) AS y,
  CASE k WHEN 'full-date' THEN {_framed(R_FULL, 5, 'DATE')} WHEN 'month-year' THEN {_framed(R_MY, 4, 'MONTH-YEAR')} WHEN 'year' THEN {_framed(R_Y, 3, 'YEAR')} WHEN 'leading' THEN {_x(R_LEAD, 2)} WHEN 'short-year' THEN {_x(R_SHORT, 1)} END AS base0,
  CASE k WHEN 'full-date' THEN {_x(R_FULL, 2)} || {_x(R_FULL, 3)} || {_x(R_FULL, 4)} WHEN 'month-year' THEN {_x(R_MY, 2)} || {_x(R_MY, 3)} WHEN 'year' THEN {_x(R_Y, 2)} WHEN 'leading' THEN {_x(R_LEAD, 1)} WHEN 'short-year' THEN {_x(R_SHORT, 2)} END AS comp0,
  CASE k WHEN 'full-date' THEN {_x(R_FULL, 3)} WHEN 'month-year' THEN {_x(R_MY, 2)} END AS month0,
  CASE WHEN k IN ('leading') THEN 'leading' WHEN (k = 'full-date' AND {_x(R_FULL, 5)} <> '') OR (k = 'month-year' AND {_x(R_MY, 4)} <> '') OR (k = 'year' AND {_x(R_Y, 3)} <> '') THEN 'middle' ELSE 'trailing' END AS pos0 FROM k1),
k3 AS (SELECT *, {YEAR} - y AS age0, CASE WHEN {YEAR} - y < 0 THEN 'future' WHEN {YEAR} - y <= 2 THEN 'recent_timestamp' WHEN {YEAR} - y <= 12 THEN 'underage' WHEN {YEAR} - y <= 65 THEN 'plausible_birth_year' WHEN {YEAR} - y <= 100 THEN 'elderly_birth_year' ELSE 'ancient' END AS cat FROM k2),
k4 AS (SELECT *, CAST(CASE cat WHEN 'future' THEN 0.95 WHEN 'recent_timestamp' THEN 0.9 WHEN 'underage' THEN 0.7 WHEN 'plausible_birth_year' THEN CASE k WHEN 'month-year' THEN 0.6 WHEN 'full-date' THEN 0.75 ELSE 0.2 END WHEN 'elderly_birth_year' THEN 0.4 ELSE 0.8 END AS DOUBLE) AS r FROM k3),
k5 AS (SELECT *, CASE k WHEN 'none' THEN 0.0 ELSE greatest(0.0, least(1.0, r + CASE WHEN k = 'month-year' AND y IN ({YEAR}, {YEAR + 1}) THEN 0.1 WHEN k = 'year' THEN CASE pos0 WHEN 'trailing' THEN 0.05 ELSE -0.05 END WHEN k = 'leading' THEN 0.1 WHEN k = 'short-year' THEN -0.05 ELSE 0.0 END)) END AS c0 FROM k4),
dat AS (SELECT *, k <> 'none' AND NOT (k = 'short-year' AND c0 < 0.1) AS has FROM k5)"""

# N1 to N4 over local part l; w is its letters
LANG = """CASE WHEN regexp_matches(l, '(ov|ova|ovich|ev|eva|enko|sky|ski|ashvili|adze|dze)$|(ullah|rahman|hossain|hussein)$|^(abd|abu|ibn|bin)|(putra|putri|wati|wana|wan|budi|sri|dra|tya)$|(kumar|singh|raj|deep|esh|ish)$|(nguyen|quang|thuy|phuong|trung|trong)$|(kim|park|choi|yoon|kang|lee)$|(zhang|xiang|sheng|huang|xiao|qian)$') THEN 'romanized'
  WHEN regexp_matches(l, 'ñ|(ez|iz|oz|az)$') THEN 'es' WHEN regexp_matches(l, '(eau|eaux|eux|ette|elle|ille|ois|oit)$') THEN 'fr' WHEN regexp_matches(l, '(mann|berg|stein|stadt|hardt)$|ae|oe|ue|sch|tz|pf') THEN 'de'
  WHEN regexp_matches(l, '(ini|lli|tti|cci|gia|gio|zio|zzi|azzi|etti)$') THEN 'it' WHEN regexp_matches(l, '(ão|õe|ãe|inho|inha|lh|nh|cao|sao)$') THEN 'pt' ELSE 'en' END"""


def _sets(sets: dict) -> str:
    return "CASE language " + " ".join(f"WHEN '{k}' THEN {_list([*v, *sets['universal']])}" for k, v in sets.items() if k != "universal") + " END"


def _windows(n: int) -> str:
    return f"[substr(w, i, {n}) for i in range(1, greatest(len(w) - {n - 2}, 1))]"


def _score(n: int, known: str) -> str:
    return f"CASE WHEN len(w) >= {n} THEN len([g for g in {_windows(n)} if list_contains({known}, g)]) / (len(w) - {n - 1}) ELSE 0.0 END"


NGRAM = f"""
, g1 AS (SELECT *, regexp_replace(l, '[^a-z]', '', 'g') AS w, {LANG} AS language FROM s),
g2 AS (SELECT *, {_score(2, _sets(BIGRAMS))} AS b2, {_score(3, _sets(TRIGRAMS))} AS b3, {_score(2, _list(ENGLISH_BIGRAMS))} AS e2, {_score(3, _list(ENGLISH_TRIGRAMS))} AS e3, greatest(len(w) - 1, 0) AS n2, greatest(len(w) - 2, 0) AS n3 FROM g1),
g AS (SELECT *, b2 * 0.6 + b3 * 0.4 AS o, e2 * 0.6 + e3 * 0.4 AS eo, b2 * 0.6 + b3 * 0.4 > CASE language WHEN 'en' THEN 0.4 ELSE 0.3 END AS nat, e2 * 0.6 + e3 * 0.4 > CASE WHEN len(l) < 5 THEN 0.3 ELSE 0.4 END AS enat, least((n2 + n3) / 10, 1.0) AS conf FROM g2)"""
VOWELS = "len(regexp_replace(l, '[^aeiou]', '', 'g')) / len(l)"
UNIQUE = "len(list_distinct(string_split(l, ''))) / len(l)"
RANDOM = f"""CASE WHEN nat AND conf > 0.5 THEN false WHEN len(l) < 8 THEN false ELSE NOT nat AND ((conf > 0.7 AND ({UNIQUE} > 0.75 OR {VOWELS} < 0.15 OR {VOWELS} > 0.7))
  OR (conf > 0.6 AND ((regexp_matches(l, '[a-z]') AND regexp_matches(l, '[0-9]') AND NOT regexp_matches(l, '[._-]')) OR ({UNIQUE} > 0.75 AND ({VOWELS} < 0.15 OR {VOWELS} > 0.7))))) END"""

# S3 to S9 over local part l: each character's class from its neighbours
CHAR = "substr(l, i, 1)"
CLASS = (f"CASE WHEN {CHAR} BETWEEN '0' AND '9' THEN 'D' WHEN NOT regexp_matches({CHAR}, '[a-z]') THEN 'S' WHEN contains('aeiou', {CHAR}) THEN 'V' WHEN {CHAR} = 'y' THEN CASE WHEN (i > 1 AND contains('aeiou', substr(l, i - 1, 1))) "
         f"OR (i < len(l) AND contains('aeiou', substr(l, i + 1, 1))) THEN 'C' ELSE 'V' END WHEN {CHAR} = 'w' THEN CASE WHEN i > 1 AND contains('aeiou', substr(l, i - 1, 1)) THEN 'V' ELSE 'C' END ELSE 'C' END")


def _run(letter: str) -> str:
    return f"coalesce(list_max([len(r) for r in regexp_extract_all(cls, '{letter}+')]), 0)"


FEATS = f"""
, f1 AS (SELECT *, array_to_string([{CLASS} for i in range(1, len(l) + 1)], '') AS cls, [x for x in regexp_split_to_array(l, '[._-]+') if x <> ''] AS seg0 FROM s),
f2 AS (SELECT *, CASE WHEN len(seg0) > 0 THEN seg0 ELSE [l] END AS seg, array_to_string([CASE WHEN substr(cls, i, 1) = 'C' THEN substr(l, i, 1) ELSE '-' END for i in range(1, len(l) + 1)], '') AS cons,
  len(replace(replace(replace(cls, 'C', ''), 'D', ''), 'S', '')) AS vowels, len(replace(replace(replace(cls, 'V', ''), 'D', ''), 'S', '')) AS consonants,
  len(replace(replace(replace(cls, 'C', ''), 'V', ''), 'S', '')) AS digits, len(replace(replace(replace(cls, 'C', ''), 'D', ''), 'V', '')) AS symbols,
  len([i for i in range(2, len(l) + 1) if substr(l, i, 1) = substr(l, i - 1, 1)]) AS repeats,
  list_max([k for k in range(1, 41) if k = 1 OR len([i for i in range(1, len(l) - k + 2) if substr(l, i, k) = repeat(substr(l, i, 1), k)]) > 0]) AS max_repeat_run FROM f1),
f3 AS (SELECT *, {_run('V')} AS max_vowel_run, {_run('C')} AS max_consonant_run, {_run('D')} AS max_digit_run, len(list_distinct(string_split(l, ''))) AS unique_chars,
  len([c for c in regexp_extract_all(cons, '[a-z]{{3,}}') if NOT regexp_matches(c, 'sch|shr|spl|spr|scr|str|scl|thr|phr|chr|ght|tch|nch|ngh|nth|ndr|ngr')]) AS impossible_clusters,
  coalesce(list_sum([greatest(1, len(regexp_extract_all(t, 'V+'))) for t in regexp_extract_all(cls, '[VC]+')]), 0) AS syllables, regexp_matches(l, '[._-]') AS has_word_boundaries, len(seg) AS segment_count,
  len(l) / len(seg) AS avg_segment_length, list_max([len(x) for x in seg]) AS longest_segment, list_min([len(x) for x in seg]) AS shortest_segment,
  len([x for x in seg if NOT regexp_matches(x, '[aeiouy]')]) / len(seg) AS segments_without_vowels_ratio, greatest(vowels + consonants, 1) AS letters1 FROM f2),
f4 AS (SELECT *, vowels / letters1 AS vowel_ratio, consonants / letters1 AS consonant_ratio, digits / len(l) AS digit_ratio, symbols / len(l) AS symbol_ratio, repeats / len(l) AS repeated_char_ratio, unique_chars / len(l) AS unique_char_ratio,
  max_consonant_run / letters1 AS vowel_gap_ratio FROM f3),
f5 AS (SELECT *, greatest(0.0, least(1.0, vowel_ratio * 0.55 + (1 - (greatest(0.0, (max_consonant_run - 2) / 10) + greatest(0.0, (max_repeat_run - 2) / 12) + digit_ratio * 0.6 + symbol_ratio * 0.5 + least(1.0, impossible_clusters * 0.2)
  + segments_without_vowels_ratio * 0.5)) * 0.45 + CASE WHEN has_word_boundaries THEN 0.05 ELSE 0 END)) AS pronounceability FROM f4)"""
_INTS = ("vowels", "consonants", "digits", "symbols", "unique_chars", "max_vowel_run", "max_consonant_run", "max_digit_run", "max_repeat_run", "repeats", "impossible_clusters", "syllables", "segment_count", "longest_segment", "shortest_segment")
_REALS = ("avg_segment_length", "segments_without_vowels_ratio", "vowel_ratio", "consonant_ratio", "digit_ratio", "symbol_ratio", "repeated_char_ratio", "unique_char_ratio", "vowel_gap_ratio", "pronounceability")

LISTED = f"d IN {_in(tables.DISPOSABLE)}"
REASONS = """array_to_string([x for x in [CASE WHEN len(d) > 50 THEN 'Domain excessively long' END, CASE WHEN len(string_split(d, '.')) - 2 > 3 THEN 'Too many subdomains' END, CASE WHEN regexp_full_match(split_part(d, '.', 1), '[0-9]+') THEN 'Domain name is all numbers' END,
  CASE WHEN len(split_part(d, '.', 1)) < 3 THEN 'Domain name too short' END, CASE WHEN len(split_part(d, '.', 1)) - len(replace(split_part(d, '.', 1), '-', '')) > 3 THEN 'Too many hyphens in domain' END,
  CASE WHEN regexp_full_match(split_part(d, '.', 1), '[bcdfghjklmnpqrstvwxyz]{6,}') THEN 'Domain appears random (no vowels)' END] if x IS NOT NULL], '; ')"""
PROFILES = "(VALUES " + ", ".join("('{0}', '{1}', CAST({4} AS DOUBLE))".format(*line.split(" ", 6)) for line in tables.TLD_PROFILES.strip().splitlines()) + ") AS p(tld, category, m)"
PLATFORMS = (("vercel.app", "vercel", 0.15), ("vercel.dev", "vercel", 0.15), ("herokuapp.com", "heroku", 0.15), ("onrender.com", "render", 0.15), ("netlify.app", "netlify", 0.15), ("pages.dev", "cloudflare-pages", 0.15), ("webflow.io", "webflow", 0.15), ("github.io", "github-pages", 0.12), ("fly.dev", "fly.io", 0.15), ("cloudfront.net", "cloudfront", 0.12))
HOSTS = "(VALUES " + ", ".join(f"('{a}', '{b}', CAST({c} AS DOUBLE))" for a, b, c in PLATFORMS) + ") AS h(suffix, platform, boost)"
TLD = f"""
, t1 AS (SELECT s.id, s.d, string_split(s.d, '.')[-1] AS tld, len(string_split(s.d, '.')) AS n, p.m, coalesce(p.category, 'unknown') AS category, h.platform, h.boost, CASE WHEN h.suffix IS NULL THEN 1 ELSE 2 END AS size
  FROM s LEFT JOIN {PROFILES} ON p.tld = string_split(s.d, '.')[-1] LEFT JOIN {HOSTS} ON s.d = h.suffix OR ends_with(s.d, '.' || h.suffix)),
t2 AS (SELECT *, greatest(n - size - 1, 0) AS depth, array_to_string(string_split(d, '.')[greatest(n - size, 1):], '.') AS registrable_domain FROM t1),
tl AS (SELECT *, CASE WHEN m IS NULL THEN CASE WHEN platform IS NULL THEN 0.15 ELSE least(1, 0.25 + boost) END WHEN platform IS NULL THEN greatest(0, least(1, (m - 0.2) / 2.8)) ELSE least(1, greatest(0, least(1, (m - 0.2) / 2.8)) + boost + depth * 0.02) END AS score FROM t2)"""

SCORES = "sc AS (SELECT id, label, risk_score * 0.4 + label * 0.5 AS score FROM signups)"
SCAN = f"""
, {SCORES}, th AS (SELECT round(0.05 + i * 0.01, 3) AS threshold FROM range(91) r(i)),
cn AS (SELECT threshold, count(*) FILTER (WHERE score >= threshold AND label = 1) AS tp, count(*) FILTER (WHERE score >= threshold AND label = 0) AS fp, count(*) FILTER (WHERE score < threshold AND label = 0) AS tn, count(*) FILTER (WHERE score < threshold AND label = 1) AS fn FROM th, sc GROUP BY 1),
scan AS (SELECT threshold, tp, fp, tn, fn, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) ELSE 0 END AS precision, round(tp / (tp + fn), 6) AS recall, round(fp / (fp + tn), 6) AS fpr, round(fn / (tp + fn), 6) AS fnr,
  CASE WHEN tp > 0 THEN round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) ELSE 0 END AS f1, tp + fn AS support_positive, fp + tn AS support_negative FROM cn)"""
DECISION = "CASE WHEN risk_score > 0.88 THEN 'block' WHEN risk_score > 0.56 THEN 'warn' ELSE 'allow' END"
SAMPLES = f"""
, sm AS (SELECT id, sha256(e) AS email_hash, timestamp, CAST(CASE WHEN id % 13 = 0 THEN 1 WHEN id % 2 = 0 AND risk_score < 0.2 THEN 0 WHEN {DECISION} = 'block' THEN 1 WHEN {DECISION} = 'allow' THEN 0 WHEN risk_score >= 0.5 THEN 1 ELSE 0 END AS INT) AS label,
  CASE WHEN id % 13 = 0 THEN 'known_disposable' WHEN id % 2 = 0 AND risk_score < 0.2 THEN 'known_provider' ELSE 'model' END AS label_source FROM s)"""
CLEAN0 = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(trim(lower({DIRTY})), 'mailto:', ''), '^<+', ''), '>+$', ''), '[\"''()\\[\\]{{}}]|\\s+', '', 'g'), '[.,;]+$', ''), '\\.{{2,}}', '.', 'g')".replace("{{", "{").replace("}}", "}")
CLEAN = f", cl AS (SELECT id, label, CASE WHEN regexp_matches({CLEAN0}, '^[^@]+@[^@]*\\.[^@]*$') THEN {CLEAN0} END AS clean FROM s)"
FMT = "^[\\p{L}\\p{N}!#$%&''*+/=?^_`{|}~.-]+@[\\p{L}\\p{N}]([\\p{L}\\p{N}-]{0,61}[\\p{L}\\p{N}])?(\\.[\\p{L}\\p{N}]([\\p{L}\\p{N}-]{0,61}[\\p{L}\\p{N}])?)*$"
ODDS = f"{WITH_SIGNUPS}, s0 AS (SELECT id, lower(trim({ODD})) AS e FROM signups), s AS (SELECT *, split_part(e, '@', 1) AS l, split_part(e, '@', 2) AS d FROM s0), ok AS (SELECT *, regexp_matches(e, '{FMT}') AND len(l) BETWEEN 1 AND 64 AND len(d) <= 255 AND contains(d, '.') AND len(string_split(d, '.')[-1]) >= 2 AS ok FROM s)"
BENFORD = (0.301, 0.176, 0.125, 0.097, 0.079, 0.067, 0.058, 0.051, 0.046)

# F8: the score and reasons after each rule
LIFTS = ", x0 AS (SELECT id, risk_score, id % 77 / 77 AS x, '' AS r FROM s)" + "".join(
    f", y{k} AS (SELECT *, CASE {' '.join(f'WHEN {v} >= {t} THEN {g}' for t, g, _ in rules)} END AS g, CASE {' '.join(f'WHEN {v} >= {t} THEN {chr(39)}{name}{chr(39)}' for t, _, name in rules)} END AS n FROM x{k}), "
    f"x{k + 1} AS (SELECT id, risk_score, CASE WHEN g > x THEN g ELSE x END AS x, CASE WHEN g > x THEN CASE WHEN r = '' THEN n ELSE r || ',' || n END ELSE r END AS r FROM y{k})" for k, (v, rules) in enumerate(RULES))

# Dated and numbered forms of the address as its provider reads it, structure and randomness of the one without its tag
BASE9 = f"{WITH_SIGNUPS}, s8 AS (SELECT *, lower(trim(email)) AS e, split_part(lower(trim(email)), '@', 1) AS l, split_part(lower(trim(email)), '@', 2) AS d FROM signups), s AS (SELECT id, d, {DOTLESS} AS l FROM s8), s9 AS (SELECT id, d, split_part(l, '+', 1) AS l, contains(l, '+') AS plus, coalesce(regexp_matches({TAG}, '{SUSPICIOUS}'), false) AS odd FROM s8)"
FAMILY = f"""{SEQ} {DATED} {NGRAM.replace('FROM s)', 'FROM s9)')},
fam AS (SELECT g.id, g.l, g.d, g.plus, q.c >= 0.4 AS has_sequential, dd.has AS has_dated,
  CASE WHEN dd.has AND dd.c0 >= 0.6 THEN 'dated' WHEN q.c >= 0.5 THEN 'sequential' WHEN g.plus THEN 'plus-addressing' WHEN {RANDOM.replace('l,', 'g.l,').replace('(l)', '(g.l)')} THEN 'random' WHEN regexp_matches(g.l, '[._-]') THEN 'formatted' ELSE 'simple' END AS type,
  dd.c0, q.c, g.odd, {_structure('g.l')} AS structure, {_structure('dd.base0')} AS sd, {_structure('q.b')} AS sq, CASE dd.k WHEN 'short-year' THEN 'YY' WHEN 'month-year' THEN 'MONTH-YEAR' WHEN 'full-date' THEN 'DATE' ELSE 'YEAR' END AS token
  FROM g JOIN seq q USING (id) JOIN dat dd USING (id)),
p9 AS (SELECT *, CASE type WHEN 'dated' THEN sd || '.' || token WHEN 'sequential' THEN sq || '.NUM' WHEN 'plus-addressing' THEN structure || '+TAG' WHEN 'random' THEN 'RANDOM' ELSE structure END || '@' || d AS family,
  CASE type WHEN 'dated' THEN c0 WHEN 'sequential' THEN c WHEN 'plus-addressing' THEN CASE WHEN odd THEN 0.7 ELSE 0.5 END WHEN 'random' THEN 0.6 WHEN 'formatted' THEN 0.4 ELSE 0.3 END AS confidence FROM fam)"""
DOMAIN_TYPE = "CASE WHEN d IN ('gmail.com', 'yahoo.com', 'outlook.com', 'hotmail.com', 'icloud.com', 'aol.com', 'protonmail.com', 'mail.com') THEN 'free' WHEN regexp_matches(d, 'temp|trash|disposable|throwaway|fake|guerrilla|mailinator|minute') THEN 'disposable' WHEN NOT contains(d, 'mail') AND len(string_split(d, '.')) = 2 THEN 'business' ELSE 'unknown' END"
PREFIX = f"{WITH_SIGNUPS}, s0 AS (SELECT id, split_part(lower(trim(email)), '@', 1) AS l0 FROM signups), s AS (SELECT *, regexp_replace(regexp_replace(l0, '[0-9._-]+$', ''), '[^a-zA-Z]', '', 'g') AS l FROM s0)"
ACCENT = f"{WITH_SIGNUPS}, s AS (SELECT id, 'é' || split_part(lower(trim(email)), '@', 1) AS l FROM signups)"

# B6 by hour
TAIL = "0.3989422804014327 * exp(-0.5 * z * z) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))"
DIGITS = f"""
, dg AS (SELECT hour(timestamp) AS hour, CAST(substr(unnest(regexp_extract_all(l, '[0-9]+')), 1, 1) AS INT) AS digit FROM s),
bn AS (SELECT hour, count(*) AS n, {', '.join(f'count(*) FILTER (WHERE digit = {i}) AS d{i}' for i in range(1, 10))} FROM dg WHERE digit > 0 GROUP BY 1),
bx AS (SELECT *, {' + '.join(f'(d{i} - {p} * n) ** 2 / ({p} * n)' for i, p in enumerate(BENFORD, 1))} AS x, ({' + '.join(f'abs(d{i} / n - {p})' for i, p in enumerate(BENFORD, 1))}) / 9 AS dev FROM bn),
bz AS (SELECT *, ((x / 8) ** (1.0 / 3) - (1 - 2 / 72)) / sqrt(2 / 72) AS z FROM bx), bt AS (SELECT *, 1 / (1 + 0.2316419 * abs(z)) AS t, greatest(CASE WHEN x >= 15.507 THEN least(x / 30, 1) ELSE 0 END, least(1, dev * 2)) AS risk FROM bz)"""

MXR = """
, r0 AS (SELECT id, (id % 97) || '.' || d AS domain, CASE WHEN id % 11 = 0 THEN 'bad' ELSE (id % 50) || ' ' || CASE id % 5 WHEN 0 THEN 'alt1.l.google.com.' WHEN 1 THEN 'x.mail.protection.outlook.com.' WHEN 2 THEN 'mx.zoho.com.' WHEN 3 THEN 'mail.other.net.' ELSE 'mx.' || d || '.' END END AS data, d FROM s),
r1 AS (SELECT id, domain, CASE WHEN data <> 'bad' THEN CASE id % 5 WHEN 0 THEN 'google' WHEN 1 THEN 'microsoft' WHEN 2 THEN 'other' WHEN 3 THEN 'other' ELSE CASE WHEN d = 'outlook.com' THEN 'microsoft' ELSE 'other' END END END AS provider FROM r0),
r2 AS (SELECT domain, provider, count(*) AS hits, max(id) AS reached FROM r1 WHERE provider IS NOT NULL GROUP BY ALL), r3 AS (SELECT DISTINCT domain FROM r1)"""
ALL_PROFILES = "(VALUES " + ", ".join("('{0}', '{1}', CAST({2} AS DOUBLE), CAST({3} AS DOUBLE), CAST({4} AS DOUBLE), '{5}', '{6}')".format(*(w.replace("'", "''") for w in line.split(" ", 6))) for line in tables.TLD_PROFILES.strip().splitlines()) + ") AS p(tld, category, disposable_ratio, spam_ratio, m, registration_cost, description)"
F1 = {"entropy_score": "latency", "local_length": "len(email) * 5", "digit_ratio": "risk_score - 0.5", "name_in_email": "CASE WHEN label = 1 THEN 1 ELSE 0 END"}

# The records by their own domains
OWN_MX = MXR.replace("(id % 97) || '.' || d AS domain", "d AS domain").replace("'microsoft' ELSE 'other' END END END", "'microsoft' ELSE 'self_hosted' END END END")

#: Well-known domains' own records come before those; providers by their hosts, self_hosted where these end in the domain.
_KNOWN = {d: sum(line.split()[0] == d for line in tables.KNOWN_MX.strip().splitlines()) for d in ("gmail.com", "yahoo.com", "outlook.com", "proton.me", "mail.com")}
KNOWN_MX = "(VALUES " + ", ".join(f"('{d}', {_KNOWN[d]}, '{p}')" for d, p in (("gmail.com", "google"), ("yahoo.com", "yahoo"), ("outlook.com", "self_hosted"), ("mail.com", "self_hosted"), ("proton.me", "proton")) if _KNOWN[d]) + ") AS known(d, n, p)"

# what the small models look at
MODELLED = f"""{FEATS} {TLD}, en AS (SELECT id, least({_entropy("(string_split(l, ''))")} / 6.6, 1.0) AS entropy_score FROM s8),
md AS (SELECT f4.id, digit_ratio, entropy_score, CAST(tl.score AS DOUBLE) AS tld_risk_score FROM f4 JOIN tl ON f4.id = tl.id JOIN en ON f4.id = en.id)"""

# Shares of first digits by day and label; a zero for each address keeps days without digits
BY_DAY = f"""
, dd AS (SELECT label, CAST(timestamp AS DATE) AS day, unnest(list_concat([0], [CAST(substr(r, 1, 1) AS INT) for r in regexp_extract_all(l, '[0-9]+')])) AS digit FROM s),
dc AS (SELECT label, day, count(*) FILTER (WHERE digit > 0) AS n, [{', '.join(f'count(*) FILTER (WHERE digit = {i})' for i in range(1, 10))}] AS v FROM dd GROUP BY ALL),
dx AS (SELECT label, day, [CASE WHEN n >= 30 THEN c / n ELSE 0.0 END for c in v] AS v FROM dc),
dy AS (SELECT a.day, coalesce(list_inner_product(a.v, b.v) / nullif(sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v)), 0), 0.0) AS x FROM dx a JOIN dx b ON a.day = b.day WHERE a.label = 0 AND b.label = 1)"""

# T24 over domains of name n and ending z
SUBSTITUTES = "CASE substr(n, i, 1) " + " ".join(f"WHEN '{k}' THEN {_list(v)}" for k, v in SUBSTITUTIONS.items()) + " ELSE [] END"
TYPOS = f"""
, ty AS (SELECT domain, split_part(domain, '.', 1) AS n, split_part(domain, '.', 2) AS z, range(1, len(split_part(domain, '.', 1)) + 1) AS places FROM (SELECT DISTINCT d AS domain FROM s)),
tv AS (SELECT domain, z, n, unnest(places) AS i FROM ty),
vr AS (SELECT domain, substr(n, 1, i - 1) || x || substr(n, i + 1) || '.' || z AS variant FROM (SELECT *, unnest({SUBSTITUTES}) AS x FROM tv)
  UNION ALL SELECT domain, substr(n, 1, i - 1) || substr(n, i + 1, 1) || substr(n, i, 1) || substr(n, i + 2) || '.' || z FROM tv WHERE i < len(n)
  UNION ALL SELECT domain, substr(n, 1, i) || substr(n, i) || '.' || z FROM tv
  UNION ALL SELECT domain, substr(n, 1, i - 1) || substr(n, i + 1) || '.' || z FROM tv WHERE len(n) >= 4
  UNION ALL SELECT domain, n || '.' || x FROM (SELECT *, unnest({_list(TLD_MISTAKES)}) AS x FROM ty) WHERE x <> z)"""

# ST5: a window opens at the first hit after the last one's end
# D10 of name and local part l. Rows of the table of common subsequences are running maxima.
IDENTITY = """, i1 AS (SELECT *, coalesce(length(name) > 0 AND length(l) > 0, false) AS there, regexp_extract_all(lower(coalesce(name, '')), '[a-z]{2,}') AS tk, regexp_replace(lower(l), '[^a-z]', '', 'g') AS lt FROM s),
i2 AS (SELECT DISTINCT array_to_string(tk, '') AS jn, lt, string_split(lt, '') AS b FROM i1),
i3 AS (SELECT jn, lt, CASE WHEN jn = '' OR lt = '' THEN 0 ELSE list_max(list_reduce(string_split(jn, ''), lambda r, x: list_transform(range(1, len(b) + 2), lambda j: list_max(list_transform(range(1, j + 1),
  lambda k: CASE WHEN k = 1 THEN 0 WHEN b[k - 1] = x THEN r[k - 1] + 1 ELSE r[k] END))), list_transform(range(0, len(b) + 1), lambda z: 0))) END AS n FROM i2),
idn AS (SELECT i1.*, CASE WHEN there THEN n / greatest(length(jn), length(i1.lt), 1) ELSE 0.0 END AS similarity, CASE WHEN there THEN len([t for t in tk if contains(i1.lt, t)]) ELSE 0 END AS found,
  CASE WHEN there AND len(tk) > 0 THEN len([t for t in tk if contains(i1.lt, t)]) / len(tk) ELSE 0.0 END AS overlap FROM i1 JOIN i3 ON array_to_string(i1.tk, '') = i3.jn AND i1.lt = i3.lt)"""

# Newton steps from (0, 0) over counts of equal scores; st is coefficient, intercept, and whether the last step was small.
PLATT = """, pr AS (SELECT risk_score AS v, label AS y, count(*) AS n FROM s GROUP BY ALL), nn AS (SELECT sum(n) FILTER (WHERE y = 1) AS pos, sum(n) FILTER (WHERE y = 0) AS neg FROM pr),
ls AS (SELECT list(v ORDER BY v, y) AS v, list(CASE WHEN y = 1 THEN (pos + 1) / (pos + 2) ELSE 1 / (neg + 2) END ORDER BY v, y) AS t, list(CAST(n AS DOUBLE) ORDER BY v, y) AS n, count(*) AS k FROM pr, nn),
cf AS (SELECT list_reduce(range(100), lambda st, i: CASE WHEN st[3] > 0 THEN st ELSE list_transform(list_transform([list_transform(range(1, k + 1), lambda j: 1 / (1 + exp(-(st[1] * v[j] + st[2]))))],
  lambda p: [list_sum(list_transform(range(1, k + 1), lambda j: (p[j] - t[j]) * n[j] * v[j])), list_sum(list_transform(range(1, k + 1), lambda j: (p[j] - t[j]) * n[j])), list_sum(list_transform(range(1, k + 1), lambda j: (p[j] * (1 - p[j]) + 1e-12) * n[j] * v[j] * v[j])),
    list_sum(list_transform(range(1, k + 1), lambda j: (p[j] * (1 - p[j]) + 1e-12) * n[j] * v[j])), list_sum(list_transform(range(1, k + 1), lambda j: (p[j] * (1 - p[j]) + 1e-12) * n[j]))]),
  lambda h: [st[1] - (h[5] * h[1] - h[4] * h[2]) / (h[3] * h[5] - h[4] * h[4]), st[2] - (h[3] * h[2] - h[4] * h[1]) / (h[3] * h[5] - h[4] * h[4]),
    CASE WHEN abs((h[5] * h[1] - h[4] * h[2]) / (h[3] * h[5] - h[4] * h[4])) < 1e-8 AND abs((h[3] * h[2] - h[4] * h[1]) / (h[3] * h[5] - h[4] * h[4])) < 1e-8 THEN 1.0 ELSE 0.0 END])[1] END, [CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)]) AS st FROM ls),
coef AS (SELECT [round(st[1], 6), round(st[2], 6)] AS c FROM cf)"""

HITS = f"""{WITH_VALIDATIONS.replace('WITH', 'WITH RECURSIVE', 1)}, h AS (SELECT CAST(id AS VARCHAR) AS id, client_ip AS k, timestamp AS t, row_number() OVER (PARTITION BY client_ip ORDER BY timestamp, CAST(id AS VARCHAR)) AS n FROM validations),
o AS (SELECT id, k, n, t AS opened, 1 AS hits FROM h WHERE n = 1
  UNION ALL SELECT h.id, h.k, h.n, CASE WHEN h.t > opened + INTERVAL 1 HOUR THEN h.t ELSE opened END, CASE WHEN h.t > opened + INTERVAL 1 HOUR THEN 1 ELSE hits + 1 END FROM o JOIN h ON h.k = o.k AND h.n = o.n + 1)"""

ORACLE_SQL = {
    "d9_mx_join": _q(f"{OWN_MX}, mx AS (SELECT r3.domain, CAST(coalesce(sum(hits), 0) AS BIGINT) AS mx_record_count, arg_min(provider, (-hits, reached)) AS mx_primary_provider, coalesce(sum(hits), 0) > 0 AS mx_has_records FROM r3 LEFT JOIN r2 USING (domain) GROUP BY 1) SELECT id, s.d AS domain, CAST(coalesce(n, mx_record_count) AS BIGINT) AS mx_record_count, coalesce(p, mx_primary_provider) AS mx_primary_provider, n IS NOT NULL OR mx_has_records AS mx_has_records FROM s LEFT JOIN mx ON mx.domain = s.d LEFT JOIN {KNOWN_MX} ON known.d = s.d"),
    "f4_forest_score": _q(f"{MODELLED}, m AS (SELECT *, (CASE WHEN digit_ratio > 0.3 THEN 0.9 WHEN tld_risk_score > 0.5 THEN 0.7 ELSE 0.1 END + CASE WHEN entropy_score > 0.45 THEN 0.6 ELSE 0.2 END) / 2 AS x FROM md) SELECT id, round(digit_ratio, 6) AS digit_ratio, round(entropy_score, 6) AS entropy_score, round(tld_risk_score, 6) AS tld_risk_score, round(1 / (1 + exp(2.0 - 4.0 * x)), 6)::DOUBLE AS score FROM m", BASE9),
    "f5_decision_tree": _q(f"{MODELLED}, m AS (SELECT id, CASE WHEN digit_ratio <= 0.3 THEN 0 WHEN tld_risk_score > 0.5 THEN 1 ELSE 2 END + 1 AS leaf FROM md) SELECT id, CAST([0.2, 0.95, 0.6][leaf] AS DOUBLE) AS score, ['few_digits', 'bad_tld', 'digits'][leaf] AS reason, ['digit_ratio <= 0.3', 'not digit_ratio <= 0.3; tld_risk_score > 0.5', 'not digit_ratio <= 0.3; not tld_risk_score > 0.5'][leaf] AS path FROM m", BASE9),
    "b8_compare_distributions": _q(f"{BY_DAY} SELECT day, round(x, 6) AS similarity, x > 0.9 AS similar FROM dy"),
    "t24_typosquats": _q(f"{TYPOS} SELECT domain, variant FROM vr"),
    "t24_lookalikes": _q(f"{TYPOS}, im AS (SELECT variant, min(domain) AS imitates FROM vr GROUP BY 1), fo AS (SELECT id, regexp_replace(d, '^([^o.]*)o', '\\10') AS domain FROM s) SELECT id, domain, imitates FROM fo JOIN im ON domain = variant WHERE domain NOT IN (SELECT d FROM s)"),
    "d10_identity": _q(f"{IDENTITY} SELECT id, round(similarity, 6) AS similarity, round(overlap, 6) AS token_overlap, found > 0 AS name_in_email FROM idn"),
    "st5_limit_hits": f"{HITS} SELECT id, hits > 2 AS limited FROM o",
    "p9_pattern_family": _q(f"{FAMILY} SELECT id, family, substr(sha256(family), 1, 16) AS family_hash, type, round(confidence, 6)::DOUBLE AS confidence, l || '@' || d AS normalized, has_sequential, has_dated, plus AS has_plus, structure, {DOMAIN_TYPE} AS domain_type FROM p9", BASE9),
    "b5_pattern_families": _q(f"{FAMILY}, c1 AS (SELECT family, type, count(*) AS n FROM p9 GROUP BY ALL), c2 AS (SELECT family, sum(n) AS \"count\", arg_max(type, (n, type)) AS type FROM c1 GROUP BY 1) SELECT family, CAST(\"count\" AS BIGINT) AS \"count\", type, row_number() OVER (ORDER BY \"count\" DESC, family) = 1 AS is_top, \"count\" >= 5 OR (\"count\" >= 3 AND type IN ('sequential', 'dated')) AS suspicious FROM c2", BASE9),
    "b2_plus_tag_pattern": _q(f", tg AS (SELECT {CANONICAL} AS canonical, {TAG} AS tag, TRY_CAST(CASE WHEN regexp_full_match({TAG}, '[0-9]+') THEN {TAG} END AS BIGINT) AS x FROM s), ag AS (SELECT canonical, count(*) AS n_tags, count(x) AS k, list_sort(list(DISTINCT x) FILTER (WHERE x IS NOT NULL)) AS xs, bool_or(regexp_matches(tag, '20[0-9][0-9]|jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec')) AS dates, count(DISTINCT lower(tag)) AS kinds FROM tg WHERE len(tag) > 0 GROUP BY 1), pt AS (SELECT *, CASE WHEN n_tags < 2 THEN 'none' WHEN k >= 2 AND len([i for i in range(2, len(xs) + 1) if xs[i] - xs[i - 1] > 5]) = 0 THEN 'sequential' WHEN dates THEN 'dated' WHEN kinds = 1 AND n_tags >= 3 THEN 'keyword' ELSE 'none' END AS pattern FROM ag) SELECT canonical, n_tags, pattern, CAST(CASE pattern WHEN 'sequential' THEN 0.85 WHEN 'dated' THEN 0.75 WHEN 'keyword' THEN 0.8 ELSE 0 END AS DOUBLE) AS confidence FROM pt"),
    "b6_benford": _q(f"{DIGITS}, hs AS (SELECT hour(timestamp) AS hour, count(*) AS addresses FROM s GROUP BY 1), e AS (SELECT hs.hour, addresses, coalesce(n, 0) AS size, coalesce(n, 0) >= 30 AS ok, x, z, t, dev, risk FROM hs LEFT JOIN bt USING (hour)) SELECT CAST(hour AS INT) AS hour, CAST(size AS BIGINT) AS sample_size, round(CASE WHEN ok THEN x ELSE 0 END, 6) AS chi_square, round(CASE WHEN NOT ok OR z < -8 THEN 1 WHEN z > 8 THEN 0 WHEN z >= 0 THEN {TAIL} ELSE 1 - {TAIL} END, 6) AS p_value, ok AND x < 15.507 AS follows, round(CASE WHEN ok AND x < 15.507 THEN greatest(0, 1 - x / 15.507) ELSE 0 END, 6) AS confidence, round(CASE WHEN ok THEN dev ELSE 0 END, 6) AS deviation, round(CASE WHEN ok THEN risk ELSE 0 END, 6) AS risk, ok AND risk > 0.7 AS automated, addresses >= 30 AND ok AND x >= 15.507 AND dev > 0.1 AS suspicious FROM e"),
    "s10_name_digit_hints": _q(f"{NGRAM} SELECT id, coalesce(TRY_CAST(regexp_extract(l0, '([0-9][0-9][0-9][0-9])$', 1) AS INT) BETWEEN 1940 AND 2025, false) AS has_year_suffix, l AS alpha_prefix, round(CASE WHEN len(l) >= 2 THEN o ELSE 0.0 END, 6) AS alpha_prefix_naturalness, round(CASE WHEN regexp_matches(l0, '[0-9]') THEN len(regexp_extract(l0, '^[^0-9]*')) / len(l0) ELSE 0.5 END, 6) AS digit_position_ratio FROM g", PREFIX),
    "n2_naturalness": _q(f"{NGRAM} SELECT id, language, round(b2, 6) AS bigram_score, round(b3, 6) AS trigram_score, round(o, 6) AS overall_score, nat AS is_natural, round(least((len(w) + greatest(len(w) - 1, 0)) / 10, 1.0), 6) AS confidence, CAST(len(w) AS INT) AS total_bigrams, CAST(greatest(len(w) - 1, 0) AS INT) AS total_trigrams, CAST(floor(len(w) * b2 + 0.5) AS INT) AS matched_bigrams, CAST(floor(greatest(len(w) - 1, 0) * b3 + 0.5) AS INT) AS matched_trigrams FROM g", ACCENT),
    "d7_override_profiles": _q(f", up AS (SELECT string_split(d, '.')[-1] AS tld, avg(label) * 3 AS m FROM s GROUP BY 1) SELECT p.tld, category, disposable_ratio, spam_ratio, round(coalesce(up.m, p.m), 6) AS risk_multiplier, registration_cost, description FROM {ALL_PROFILES} LEFT JOIN up USING (tld)"),
    "d8_mx_analysis": _q(f"{MXR} SELECT r3.domain, CAST(coalesce(sum(hits), 0) AS BIGINT) AS mx_record_count, {', '.join(f'CAST(coalesce(sum(hits) FILTER (WHERE provider = {chr(39)}{p}{chr(39)}), 0) AS BIGINT) AS mx_{p}' for p in ('google', 'microsoft', 'icloud', 'yahoo', 'zoho', 'proton', 'self_hosted', 'other'))}, arg_min(provider, (-hits, reached)) AS mx_primary_provider, max(reached) AS mx_ttl, coalesce(sum(hits), 0) > 0 AS mx_has_records FROM r3 LEFT JOIN r2 USING (domain) GROUP BY 1"),
    "f1_feature_vector": _q("SELECT id, " + ", ".join(f"round(CAST(least(greatest({F1[n]}, {low}), {high}) AS DOUBLE), 6) AS {n}" if n in F1 else f"CAST({fallback} AS DOUBLE) AS {n}" for n, low, high, fallback in FEATURES) + " FROM s"),
    "f8_heuristic_lifts": _q(f"{LIFTS} SELECT id, round(CAST(x AS DOUBLE), 6) AS score, r AS reasons FROM x5"),
    "t2_upsert_samples": _q(f"{SAMPLES}, rk AS (SELECT *, row_number() OVER (PARTITION BY email_hash ORDER BY timestamp DESC, id % 2 DESC, label DESC) AS k FROM sm) SELECT email_hash, label, label_source, timestamp FROM rk WHERE k = 1"),
    "t3_correct_labels": _q(f"{SAMPLES}, rk AS (SELECT *, row_number() OVER (PARTITION BY email_hash ORDER BY timestamp DESC, id % 2 DESC, label DESC) AS k FROM sm), fx AS (SELECT DISTINCT sha256(CASE WHEN id % 20 = 3 THEN 'x' || e ELSE e END) AS email_hash FROM s WHERE id % 10 = 3) SELECT email_hash, CASE WHEN f.h IS NOT NULL THEN 1 ELSE label END AS label, CASE WHEN f.h IS NOT NULL THEN 'manual' ELSE label_source END AS label_source, CASE WHEN f.h IS NOT NULL THEN TIMESTAMP '2024-03-01 00:00:00' ELSE timestamp END AS timestamp FROM (SELECT * FROM rk WHERE k = 1) FULL JOIN (SELECT email_hash, 1 AS h FROM fx) f USING (email_hash)"),
    "b1_alias_members": _q(f", c AS (SELECT id, d AS domain, {CANONICAL} AS canonical FROM s), n AS (SELECT domain, canonical, count(*) AS n FROM c GROUP BY ALL), b AS (SELECT domain, arg_min(canonical, (-n, canonical)) AS canonical FROM n GROUP BY 1) SELECT id, domain, canonical FROM c JOIN b USING (domain, canonical)"),
    "b3_sequential_members": _q(f"{SEQ}, c1 AS (SELECT id, d AS domain, b || '[NUM]@' || d AS family FROM seq WHERE c >= 0.4), n AS (SELECT domain, family, count(*) AS n FROM c1 GROUP BY ALL), t AS (SELECT domain, arg_min(family, (-n, family)) AS family FROM n GROUP BY 1 HAVING max(n) >= 2) SELECT id, domain, family FROM c1 JOIN t USING (domain, family)"),
    "b4_dated_members": _q(f"{DATED}, c1 AS (SELECT id, d AS domain, comp0 AS component, '[PATTERN].' || CASE k WHEN 'month-year' THEN '[MONTH-YEAR]' WHEN 'full-date' THEN '[DATE]' ELSE '[YEAR]' END || '@' || d AS family FROM dat WHERE has), n AS (SELECT domain, family, count(*) AS n FROM c1 GROUP BY ALL), t AS (SELECT domain, arg_min(family, (-n, family)) AS family FROM n GROUP BY 1 HAVING max(n) >= 2) SELECT id, domain, family, component FROM c1 JOIN t USING (domain, family)"),
    "t10_platt": _q(f"{PLATT} SELECT id, round(1 / (1 + exp(-(c[1] * risk_score + c[2]))), 6) AS calibrated FROM s, coef"),
    "c1_clean_address": _q(f"{CLEAN} SELECT id, clean FROM cl"),
    "c2_clean_dataset": _q(f"{CLEAN} SELECT min(id) AS id, clean AS email, CASE WHEN arg_min(label, id) = 1 THEN 'fraud' ELSE 'legit' END AS label, 'clean' AS source FROM cl WHERE clean IS NOT NULL GROUP BY clean"),
    "c2_clean_counts": _q(f"{CLEAN} SELECT count(DISTINCT clean) AS kept, count(clean) - count(DISTINCT clean) AS duplicates, count(*) FILTER (WHERE clean IS NULL) AS invalid FROM cl"),
    "c3_validate_format": _q("SELECT id, ok FROM ok", ODDS),
    "c4_validate_email": _q(f", v AS (SELECT *, CASE WHEN ok THEN least({_entropy('string_split(l, chr(0))').replace('chr(0)', chr(39) * 2)} / 6.6, 1.0) ELSE 0.0 END AS en, CAST(CASE WHEN ok THEN len(l) ELSE 0 END AS INT) AS ll FROM ok) SELECT id, ok AND en <= 0.85 AND ll >= 3 AS valid, CASE WHEN NOT ok THEN 'Invalid email format' WHEN en > 0.85 THEN 'Suspicious random string pattern detected' WHEN ll < 3 THEN 'Email local part too short' END AS reason, ok AS format_valid, round(en, 6) AS entropy, ll AS local_length FROM v", ODDS),
    "c5_normalize_email": _q(f"SELECT id, e AS original, split_part(l, '+', 1) || '@' || d AS normalized, contains(l, '+') AS has_plus, {TAG} AS plus_tag, {CANONICAL} AS provider_normalized, CAST(len(split_part(l, '+', 1)) - len({DOTLESS}) AS INT) AS dots_removed, coalesce(regexp_matches({TAG}, '{SUSPICIOUS}'), false) AS suspicious_tag FROM s"),
    "c7_canonical": _q(f"SELECT id, {CANONICAL} AS canonical, d IN ('gmail.com', 'googlemail.com', 'yahoo.com', 'outlook.com', 'hotmail.com', 'live.com', 'icloud.com', 'me.com', 'protonmail.com', 'proton.me', 'fastmail.com') AS supports_plus, {CANONICAL} = replace(split_part(l, '+', 1) || '@' || d, '.', '') AS same_without_dots FROM s"),
    "c8_email_hash": _q("SELECT id, sha256(e) AS email_hash FROM s"),
    "c9_fingerprint": _q("SELECT id, sha256(coalesce(ip_country, '') || ':j:' || user_id || '::' || CASE WHEN id % 2 = 0 THEN CAST(id AS VARCHAR) ELSE '0' END) AS fingerprint FROM s"),
    "c10_mask_email": _q("SELECT id, CASE WHEN len(l) > 3 THEN substr(email, 1, 3) || '***' || substr(email, instr(email, '@')) ELSE email END AS masked FROM s"),
    "p1_sequential": _q(f"{SEQ} SELECT id, c >= 0.4 AS is_sequential, CASE WHEN c > 0 THEN b ELSE l END AS base, CASE WHEN c > 0 THEN CAST(m AS DOUBLE) END AS sequence, round(c, 6) AS confidence, c > 0 AND z AS leading_zeros, CAST(CASE WHEN c > 0 THEN nm ELSE 0 END AS INT) AS seq_len FROM seq"),
    "p2_sequential_family": _q(f"{SEQ} SELECT id, CASE WHEN c >= 0.4 THEN b || '[NUM]@' || d END AS family FROM seq"),
    "p3_dated": _q(f"{DATED} SELECT id, has, CASE WHEN has THEN base0 ELSE l END AS base, CASE WHEN has THEN comp0 END AS date_component, CASE WHEN has THEN replace(k, 'leading', 'year') ELSE 'none' END AS type, round(CASE WHEN has THEN c0 ELSE 0 END, 6) AS confidence, CASE WHEN has THEN y END AS year, CASE WHEN has THEN month0 END AS month, CASE WHEN has THEN pos0 END AS position, CASE WHEN has THEN age0 END AS age, CASE WHEN has THEN cat END AS category, CASE WHEN has THEN cat NOT IN ('elderly_birth_year') AND (cat <> 'plausible_birth_year' OR k IN ('month-year', 'full-date')) END AS suspicious FROM dat"),
    "p4_year_age": _q(f", a AS (SELECT id, {YEAR} - (id % 150 + 1890) AS g FROM s) SELECT id, CAST(CASE WHEN g < 0 THEN 0.95 WHEN g <= 2 THEN 0.9 WHEN g <= 12 THEN 0.7 WHEN g <= 65 THEN 0.2 WHEN g <= 100 THEN 0.4 ELSE 0.8 END AS DOUBLE) AS risk, CASE WHEN g < 0 THEN 'future' WHEN g <= 2 THEN 'recent_timestamp' WHEN g <= 12 THEN 'underage' WHEN g <= 65 THEN 'plausible_birth_year' WHEN g <= 100 THEN 'elderly_birth_year' ELSE 'ancient' END AS category, g NOT BETWEEN 13 AND 100 AS suspicious FROM a"),
    "p5_dated_family": _q(f"{DATED} SELECT id, CASE WHEN has THEN '[PATTERN].' || CASE k WHEN 'month-year' THEN '[MONTH-YEAR]' WHEN 'full-date' THEN '[DATE]' ELSE '[YEAR]' END || '@' || d END AS family FROM dat"),
    "p6_current_date": _q("SELECT id, contains(l, '2024') OR contains(l, 'oct') AS current FROM s"),
    "p7_structure": _q(f"SELECT id, {_structure('l')} AS structure FROM s"),
    "p8_is_random": _q(f"{NGRAM} SELECT id, {RANDOM} AS is_random FROM g"),
    "p10_domain_type": _q("SELECT id, CASE WHEN d IN ('gmail.com', 'yahoo.com', 'outlook.com', 'hotmail.com', 'icloud.com', 'aol.com', 'protonmail.com', 'mail.com') THEN 'free' WHEN regexp_matches(d, 'temp|trash|disposable|throwaway|fake|guerrilla|mailinator|minute') THEN 'disposable' WHEN NOT contains(d, 'mail') AND len(string_split(d, '.')) = 2 THEN 'business' ELSE 'unknown' END AS domain_type FROM s"),
    "p11_plus_risk": _q(f"SELECT id, round(least(1.0, CASE WHEN contains(l, '+') THEN 0.2 ELSE 0.0 END + CASE WHEN regexp_matches({TAG}, '{SUSPICIOUS}') THEN 0.3 ELSE 0.0 END + CASE WHEN id % 5 >= 3 THEN 0.4 ELSE 0.0 END), 6)::DOUBLE AS plus_risk FROM s"),
    "s1_entropy": _q(f"SELECT id, round(least({_entropy(chr(40) + 'string_split(l, ' + chr(39) * 2 + ')' + chr(41))} / 6.6, 1.0), 6) AS entropy, round({_entropy(PAIRS)}, 6) AS bigram_entropy FROM s"),
    "s3_local_features": _q(f"{FEATS} SELECT id, CAST(len(l) AS INT) AS length, {', '.join(f'CAST({c} AS INT) AS {c}' for c in _INTS)}, {', '.join(f'round(CAST({c} AS DOUBLE), 6) AS {c}' for c in _REALS)}, has_word_boundaries, round({_entropy(PAIRS)}, 6) AS bigram_entropy, round(least({_entropy('string_split(l, ' + chr(39) * 2 + ')')} / 6.6, 1.0), 6) AS entropy FROM f5"),
    "n1_multilingual_score": _q(f"{NGRAM} SELECT id, language, round(b2, 6) AS bigram_score, round(b3, 6) AS trigram_score, round(o, 6) AS overall_score, nat AS is_natural FROM g"),
    "n2_english": _q(f"{NGRAM} SELECT id, 'en' AS language, round(e2, 6) AS bigram_score, round(e3, 6) AS trigram_score, round(eo, 6) AS overall_score, enat AS is_natural, round(conf, 6) AS confidence, CAST(n2 AS INT) AS total_bigrams, CAST(n3 AS INT) AS total_trigrams, CAST(floor(n2 * e2 + 0.5) AS INT) AS matched_bigrams, CAST(floor(n3 * e3 + 0.5) AS INT) AS matched_trigrams FROM g"),
    "n3_detect_language": _q(f"{NGRAM} SELECT id, language FROM g"),
    "n4_ngram_risk": _q(f"{NGRAM} SELECT id, round(CASE WHEN len(l) < 3 THEN 0.1 ELSE least(greatest(0.0, 1 - o / CASE WHEN len(l) < 5 THEN 0.3 ELSE 0.4 END) * conf, 1.0) END, 6) AS risk FROM g"),
    "n5_compare_modes": _q(f"{NGRAM} SELECT id, round(eo, 6) AS english_score, round(o, 6) AS multilingual_score, language, nat AND NOT enat AS improved FROM g"),
    "d1_validate_domain": _q(f"SELECT id, NOT ({LISTED} OR regexp_matches(d, '{DISPOSABLE_PATTERN}')) AS valid, {LISTED} OR regexp_matches(d, '{DISPOSABLE_PATTERN}') AS is_disposable, d IN {_in(tables.FREE_PROVIDERS)} AS is_free, regexp_matches(d, '{DISPOSABLE_PATTERN}') AS matches_pattern, CASE WHEN {LISTED} THEN 'Known disposable email domain' WHEN regexp_matches(d, '{DISPOSABLE_PATTERN}') THEN 'Domain matches disposable pattern' END AS reason, CAST(len(d) AS INT) AS length, true AS has_valid_tld, CAST(len(string_split(d, '.')) - 2 AS INT) AS subdomain_depth FROM s"),
    "d2_disposable_pattern": _q(f"SELECT id, regexp_matches(d, '{DISPOSABLE_PATTERN}') AS matches FROM s"),
    "d3_suspicious_reasons": _q(f"SELECT id, {REASONS} AS reasons FROM s"),
    "d4_domain_reputation": _q(f"SELECT id, round(CAST(CASE WHEN {LISTED} OR regexp_matches(d, '{DISPOSABLE_PATTERN}') THEN 1.0 WHEN d IN ('mail.com', 'email.com', 'gmx.com', 'gmx.de', 'gmx.net', 'yandex.com', 'yandex.ru') THEN 0.6 WHEN d IN ('proton.me', 'protonmail.com', 'pm.me', 'tutanota.com', 'tuta.com', 'tuta.io') THEN 0.3 WHEN d IN ('gmail.com', 'googlemail.com', 'outlook.com', 'hotmail.com', 'live.com', 'icloud.com', 'yahoo.com', 'yahoo.co.uk', 'yahoo.co.jp', 'aol.com') THEN 0.1 ELSE least(1.0, 0.3 + CASE WHEN {REASONS} = '' THEN 0 ELSE 0.1 * len(string_split({REASONS}, '; ')) END + CASE WHEN len(string_split(d, '.')) - 2 > 2 THEN 0.1 * (len(string_split(d, '.')) - 2) ELSE 0 END) END AS DOUBLE), 6) AS reputation FROM s"),
    "d5_tld_risk": _q(f"{TLD} SELECT id, tld, round(CAST(score AS DOUBLE), 6) AS risk_score, category, registrable_domain, CAST(depth AS INT) AS subdomain_depth, platform, score > 0.7 OR category = 'high_risk' AS is_high_risk, category = 'trusted' AS is_trusted FROM tl"),
    "d6_tld_stats": _q(f"{TLD} SELECT category, count(*) AS \"count\", count(*) FILTER (WHERE score > 0.7 OR category = 'high_risk') AS high_risk FROM tl GROUP BY 1"),
    "d11_geo": _q(", a AS (SELECT *, CASE WHEN contains(split_part(accept_language, ',', 1), '-') THEN upper(string_split(split_part(accept_language, ',', 1), '-')[-1]) END AS c, CASE WHEN id % 2 = 0 THEN 'US' END AS z FROM s) SELECT id, c AS language_country, coalesce(ip_country <> c, false) AS language_mismatch, coalesce(ip_country <> z, false) AS timezone_mismatch, CAST(CASE WHEN ip_country <> c THEN 0.6 ELSE 0 END + CASE WHEN ip_country <> z THEN 0.4 ELSE 0 END AS DOUBLE) AS anomaly_score FROM a"),
    "f7_base_risk": _q("SELECT id, round(CAST(CASE WHEN id % 7 = 0 THEN 0.8 WHEN id % 5 = 0 THEN 0.95 WHEN id % 3 <> 0 THEN risk_score ELSE 0.88 * 0.8 END AS DOUBLE), 6) AS base FROM s"),
    "f9_professional_reduction": _q("SELECT id, round(CASE WHEN risk_score > 0.56 AND id % 2 = 0 AND id % 10 / 10 > 0.4 AND id % 11 <> 0 AND id % 3 <> 0 AND id % 13 <> 0 AND id % 17 <> 0 AND id % 8 / 8 < 0.3 AND id % 6 / 6 < 0.5 THEN risk_score * 0.5 ELSE risk_score END, 6) AS score FROM s"),
    "f10_decide": _q(f"SELECT id, {DECISION} AS decision FROM s"),
    "f13_assign_variant": _q(", a AS (SELECT id, list_sum([(instr('0123456789abcdef', substr(sha256(CAST(user_id AS VARCHAR)), i, 1)) - 1) * CAST(16 ** (8 - i) AS BIGINT) for i in range(1, 9)]) % 100 AS bucket FROM s) SELECT id, 'exp1' AS experiment_id, CASE WHEN bucket < 30 THEN 'treatment' ELSE 'control' END AS variant, CAST(bucket AS BIGINT) AS bucket FROM a"),
    "b1_plus_alias_groups": _q(f", c AS (SELECT d AS domain, {CANONICAL} AS canonical, count(*) AS n FROM s GROUP BY ALL) SELECT domain, arg_min(canonical, (-n, canonical)) AS canonical, max(n) AS \"count\", max(n) >= 3 AS has_abuse, round(CASE WHEN max(n) >= 3 THEN least(1.0, 0.6 + max(n) * 0.1) ELSE 0.0 END, 6)::DOUBLE AS confidence FROM c GROUP BY 1"),
    "b3_sequential_batch": _q(f"{SEQ}, c1 AS (SELECT d AS domain, b || '[NUM]@' || d AS family, count(*) AS n FROM seq WHERE c >= 0.4 GROUP BY ALL) SELECT domain, arg_min(family, (-n, family)) AS family, max(n) AS \"count\", round(least(1.0, 0.5 + max(n) * 0.15), 6)::DOUBLE AS confidence FROM c1 GROUP BY 1 HAVING max(n) >= 2"),
    "b4_dated_batch": _q(f"{DATED}, c1 AS (SELECT d AS domain, '[PATTERN].' || CASE k WHEN 'month-year' THEN '[MONTH-YEAR]' WHEN 'full-date' THEN '[DATE]' ELSE '[YEAR]' END || '@' || d AS family, count(*) AS n FROM dat WHERE has GROUP BY ALL) SELECT domain, arg_min(family, (-n, family)) AS family, max(n) AS \"count\", round(least(1.0, 0.7 + max(n) * 0.1), 6)::DOUBLE AS confidence FROM c1 GROUP BY 1 HAVING max(n) >= 2"),
    "t1_auto_label": _q(f"{SAMPLES} SELECT email_hash, label, label_source, timestamp FROM sm"),
    "t4_prune": _q("SELECT id, timestamp FROM s WHERE timestamp >= TIMESTAMP '2024-01-17 00:00:00'"),
    "t5_conflict_weight": _q("SELECT id, CAST(CASE WHEN latency > 3.0 AND risk_score >= 0.6 THEN 20 ELSE 1 END AS DOUBLE) AS weight FROM s"),
    "t12_threshold_scan": _q(f"{SCAN} SELECT * FROM scan"),
    "t13_recommend_cli": _q(f"{SCAN}, ok AS (SELECT threshold FROM scan WHERE recall >= 0.95 AND fpr <= 0.05 AND fnr <= 0.05) SELECT a.threshold AS warn, b.threshold AS block FROM ok a, ok b WHERE b.threshold - a.threshold >= 0.01 - 1e-9 ORDER BY 1, 2 LIMIT 1"),
    "t13_recommend_in_process": _q(f"{SCAN} SELECT min(threshold) AS warn, max(threshold) AS block FROM scan WHERE recall >= 0.88 AND fpr <= 0.1 AND fnr <= 0.12 HAVING max(threshold) - min(threshold) >= 0.05 - 1e-9"),
    "t15_evaluate": _q(", x AS (SELECT pattern_type, count(*) AS total, count(*) FILTER (WHERE id % 2 = 1 AND decision = 'block') AS tp, count(*) FILTER (WHERE id % 2 = 0 AND decision = 'block') AS fp, count(*) FILTER (WHERE id % 2 = 0 AND decision <> 'block') AS tn, count(*) FILTER (WHERE id % 2 = 1 AND decision <> 'block') AS fn, avg(latency) AS al FROM validations GROUP BY 1) SELECT pattern_type, total, tp, fp, tn, fn, round((tp + tn) * 100.0 / total, 6) AS accuracy, CASE WHEN tp + fp > 0 THEN round(tp * 100.0 / (tp + fp), 6) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp * 100.0 / (tp + fn), 6) ELSE 0.0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp * 100.0 / (2 * tp + fp + fn), 6) ELSE 0.0 END AS f1, round(al, 6) AS avg_latency FROM x", WITH_VALIDATIONS),
    "t16_unlabelled_report": _q("SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE decision = '{k}') AS {k}, round(count(*) FILTER (WHERE decision = '{k}') * 100.0 / count(*), 6) AS {k}_share" for k in ("allow", "warn", "block")) + ", round(avg(risk_score), 6) AS avg_score, count(*) FILTER (WHERE risk_score < 0.3) AS low, count(*) FILTER (WHERE risk_score >= 0.3 AND risk_score < 0.6) AS middle, count(*) FILTER (WHERE risk_score >= 0.6) AS high FROM validations", WITH_VALIDATIONS),
    "t17_detection_rate": _q("SELECT count(*) AS total, round(count(*) FILTER (WHERE decision <> 'allow') / count(*), 6) AS detection_rate, round(avg(risk_score), 6) AS avg_score, round(avg(latency), 6) AS avg_latency, round(stddev_pop(latency), 6) AS stddev_latency, round(quantile_cont(latency, 0.5), 6) AS p50, round(quantile_cont(latency, 0.95), 6) AS p95, round(quantile_cont(latency, 0.99), 6) AS p99 FROM validations", WITH_VALIDATIONS),
    "t17_floor_percentiles": _q(", r AS (SELECT latency, row_number() OVER (ORDER BY latency) - 1 AS n, count(*) OVER () AS total FROM validations WHERE latency IS NOT NULL) SELECT " + ", ".join(f"round(max(latency) FILTER (WHERE n = least(floor({q} * total), total - 1)), 6) AS p{round(q * 100)}" for q in (0.5, 0.95, 0.99)) + " FROM r", WITH_VALIDATIONS),
    "t18_conflict_metrics": _q(", x AS (SELECT count(*) AS rows, count(*) FILTER (WHERE id % 2 = 1 AND label = 1) AS tp, count(*) FILTER (WHERE id % 2 = 1 AND label = 0) AS fp, count(*) FILTER (WHERE id % 2 = 0 AND label = 1) AS fn FROM s WHERE latency > 3.0 AND risk_score >= 0.6) SELECT rows, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM x"),
    "t22_merge_datasets": _q(f"SELECT email, label, source, row_number() OVER (ORDER BY {_draw('42', 'email', 'source', 'label')}, email, source, label) - 1 AS position FROM (SELECT lower(email) AS email, CASE WHEN id % 2 = 0 THEN CAST(label AS VARCHAR) ELSE 'fraud' END AS label, CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS source FROM s)"),
    "t6_split": _q(f"SELECT id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {_draw('42', 'id')}, CAST(id AS VARCHAR)) <= floor(count(*) OVER (PARTITION BY label) * 0.8 + 0.5) THEN 'fit' ELSE 'held' END AS part FROM s"),
    "f2_shuffled_sample": _q(f"SELECT * FROM (SELECT id, row_number() OVER (ORDER BY {_draw('7', 'email', 'id', 'label')}, email, id, label) - 1 AS position FROM s) WHERE position < 500"),
    "t9_bootstrap": _q(f"SELECT CAST(tree AS INT) AS tree, count(*) FILTER (WHERE w > 0) AS in_bag, CAST(sum(w) AS BIGINT) AS draws, count(*) FILTER (WHERE w = 0) AS out_of_bag FROM (SELECT tree, {' + '.join(f'CAST(u >= {c!r} AS INT)' for c in POISSON)} AS w FROM (SELECT tree, CAST({_draw('42', 'tree', 'id')} AS DOUBLE) / 1152921504606846976.0 AS u FROM s, range(10) r(tree))) GROUP BY tree"),
    "t19_roc_area": _q(', v AS (SELECT risk_score AS v, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n FROM s GROUP BY 1), c AS (SELECT *, coalesce(sum(n) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM v) SELECT round(CAST(sum(p * (below + n / 2)) AS DOUBLE) / (sum(p) * sum(n)), 9) AS auc, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives FROM c'),
    "t25_sample_stats": _q(f"{SAMPLES} SELECT count(*) AS total, count(*) FILTER (WHERE label = 1) AS fraud, count(*) FILTER (WHERE label = 0) AS legit, " + ", ".join(f"count(*) FILTER (WHERE label_source = '{k}') AS {k}" for k in ("model", "manual", "known_disposable", "known_provider")) + ", min(timestamp) AS oldest, max(timestamp) AS newest FROM sm"),
    "t25_label_by_source": _q(f"{SAMPLES} SELECT label, label_source, count(*) AS \"count\" FROM sm GROUP BY ALL"),
    "io3_normalize_label": _q("SELECT id, CAST(CASE WHEN id % 6 IN (0, 2, 3) THEN 1 ELSE 0 END AS INT) AS label FROM s"),
    "io5_log_rows": _q("SELECT id, CASE WHEN id % 3 <> 0 THEN email END AS email, '[' || label || ']' AS labels, CAST(label = 1 AS INT) AS flag FROM s"),
    "io6_training_dataset": _q(f"{SAMPLES} SELECT CAST(id % 5 AS DOUBLE) AS a, CAST(1 AS DOUBLE) AS b, label, CAST(1 AS DOUBLE) AS weight FROM sm"),
}


def _over(name: str, email: str) -> str:
    """A statement over sign-ups with other addresses."""
    other = BASE.replace("FROM signups)", f"FROM (SELECT * REPLACE ({email} AS email) FROM signups))")
    assert ORACLE_SQL[name].startswith(BASE) and other != BASE
    return other + ORACLE_SQL[name].removeprefix(BASE)


NUMBERED = r"^(.+?)[._-]([0-9]+)[._-](.+)$"
ORACLE_SQL |= {
    "p3_all_dates": _over("p3_dated", DATES),
    "n1_all_languages": _over("n1_multilingual_score", NAMES),
    "n3_all_languages": _over("n3_detect_language", NAMES),
    "p1_numbers_between": _over("c8_email_hash", BETWEEN).split(" SELECT id, sha256")[0] + f", q1 AS (SELECT id, l, regexp_extract(l, '{NUMBERED}', 2) AS m, regexp_extract(l, '{NUMBERED}', 1) || '.[NUM].' || regexp_extract(l, '{NUMBERED}', 3) AS b FROM s), "
    "q2 AS (SELECT *, len(m) > 1 AND m[1] = '0' AS z FROM q1), q3 AS (SELECT *, 0.3 + CASE WHEN len(m) >= 3 THEN 0.2 ELSE 0 END + CASE WHEN z THEN 0.2 ELSE 0 END AS c FROM q2) "
    "SELECT id, c >= 0.4 AS is_sequential, b AS base, CAST(m AS DOUBLE) AS sequence, CAST(round(c, 6) AS DOUBLE) AS confidence, z AS leading_zeros, CAST(len(m) AS INT) AS seq_len FROM q3",
}
