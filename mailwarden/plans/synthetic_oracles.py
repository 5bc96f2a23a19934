"""SQL for the synthetic sign-ups: the same kinds over draws that DuckDB makes."""

from __future__ import annotations

from ..operators import synthetic as syn
from ..sources.fixtures import WITH_SIGNUPS


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


class Sql:
    """What synthetic.Columns offers, as SQL expressions over a column id."""

    def __init__(self, seed: int):
        self.seed, self.depth = seed, 0

    def unit(self, salt, at=None):
        key = f"'{self.seed}|{salt}|' || CAST(id AS VARCHAR)" + (f" || '|' || CAST({at} AS VARCHAR)" if at is not None else "")
        return f"(CAST(CAST('0x' || substr(md5({key}), 1, 15) AS BIGINT) AS DOUBLE) / 1152921504606846976.0)"

    def below(self, salt, n, at=None):
        return f"CAST(floor({self.unit(salt, at)} * {n}) AS INT)"

    def text(self, value):
        return _quoted(value)

    def field(self, name):
        return f'"{name}"'

    def lower(self, x):
        return f"lower({x})"

    def upper(self, x):
        return f"upper({x})"

    def cat(self, *parts):
        return "(" + " || ".join(parts) + ")"

    def pick(self, salt, options, at=None):
        return f"([{', '.join(map(_quoted, options))}])[{self.below(salt, len(options), at)} + 1]"

    def number(self, salt, n, low=0, at=None):
        return f"CAST({self.below(salt, n, at)} + {low} AS VARCHAR)"

    def many(self, salt, low, n, each):
        return f"array_to_string(list_transform(range(1, {self.below(salt, n)} + {low} + 1), lambda i: {each('i')}), '')"

    def letters(self, salt, low, n, *alphabets):
        at = lambda a: f"substr('{a}', {self.below(f'{salt}.{len(a)}', len(a), 'i')} + 1, 1)"
        return self.many(salt, low, n, lambda i: at(alphabets[0]) if len(alphabets) == 1 else f"CASE WHEN i % 2 = 1 THEN {at(alphabets[0])} ELSE {at(alphabets[1])} END")

    def choose(self, salt, *options):
        return f"CASE {self.below(salt, len(options))} " + " ".join(f"WHEN {k} THEN {o}" for k, o in enumerate(options[:-1])) + f" ELSE {options[-1]} END"

    def chance(self, salt, share, yes, no, at=None):
        return f"CASE WHEN {self.unit(salt, at)} < {share} THEN {yes} ELSE {no} END"

    def times(self, x, salt, low, n):
        return f"repeat({x}, {self.below(salt, n)} + {low})"

    def spelled(self, x, salt, share):
        return f"array_to_string(list_transform(range(1, len({x}) + 1), lambda i: {self.chance(salt, share, f'upper(substr({x}, i, 1))', f'substr({x}, i, 1)', 'i')}), '')"

    def replaced(self, x, old, new):
        return f"translate({x}, '{old}', '{new}')"


def synthetic_sql(source: str, legit_ratio: float = 0.5, seed: int = 42) -> str:
    g = Sql(seed)
    total, reach, kinds = sum(w for _, w in syn.FRAUD_WEIGHTS), 0, []
    for name, weight in syn.FRAUD_WEIGHTS[:-1]:
        reach += weight
        kinds.append(f"WHEN weight < {reach} THEN '{name}'")
    emails = [f"WHEN honest = '{k}' THEN {local} || '@' || domain" for k, local in syn.legit_kinds(g).items()]
    emails += [f"WHEN kind = '{k}' THEN {local} || '@' || {domain}" for k, (local, domain) in syn.fraud_kinds(g).items()]
    return f"""{WITH_SIGNUPS}, a AS (SELECT id, {g.unit('legit')} < {legit_ratio} AS legit, {g.unit('roll')} AS roll, {g.unit('kind')} * {total} AS weight,
  {g.pick('first', syn.FIRST)} AS first, {g.pick('last', syn.LAST)} AS last, {g.pick('domain', syn.DOMAINS)} AS domain, {g.unit('name')} < {syn.NO_NAME} AS nameless FROM {source}),
b AS (SELECT *, CASE WHEN NOT legit THEN CASE {' '.join(kinds)} ELSE '{syn.FRAUD_WEIGHTS[-1][0]}' END END AS kind,
  CASE WHEN legit THEN CASE WHEN roll < {syn.NEAR_MISS} THEN 'near' WHEN roll < {syn.NEAR_MISS + syn.DATED_LEGIT} THEN 'dated' ELSE 'plain' END END AS honest FROM a)
SELECT id, CASE {' '.join(emails)} END AS email, CASE WHEN nameless THEN '' ELSE first || ' ' || last END AS name, CASE WHEN legit THEN 'legitimate' ELSE 'fraud' END AS label,
  CASE WHEN NOT legit THEN 'synthetic_fraud' WHEN honest = 'near' THEN 'synthetic_near_legit' WHEN honest = 'dated' THEN 'synthetic_dated_legit' ELSE 'synthetic_legit' END AS source, kind FROM b"""


ORACLE_SQL = {"t23_synthetic": synthetic_sql("signups")}
