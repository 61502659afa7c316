"""A linkage fixture of two person tables made from the keys of `customer`, in expressions that mean the same in Spark SQL and DuckDB.

Each key stands for a person on side A. On side B three of four keys stand for the same person, with typing errors, nulls and changes; the
fourth stands for somebody else. Values are drawn by multiplying the key, so that their numbers grow as those of names and streets do.
"""

from __future__ import annotations

SYLLABLES = "BARDELCINFOXGUMHATJEPKIVLODMUSNAZPERQUISOBTYKVUNWEGXALZIDBROCLEDRAFLUGHYPTRAVEESKOWHIM"[:75]
PRIME = 2147483647
FAMILY = (3, 4, 5, 7)  # draws that one person in six shares with the person before: last name and address
MULTIPLIERS = (48271, 39373, 16807, 62089, 44485, 30269, 52849)


def _draw(salt: int) -> str:
    key = "case when p % 6 = 1 then p - 1 else p end" if salt in FAMILY else "p"
    return f"((({key}) + {salt * 100003}) * {MULTIPLIERS[salt - 1]} % {PRIME}) * 69621 % {PRIME} * 40692 % {PRIME} / {PRIME}.0D"


def _word(n: str, endings: tuple[str, ...]) -> str:
    part = lambda x: f"substr('{SYLLABLES}', cast(1 + 3 * ({x} % 25) as int), 3)"
    tail = " ".join(f"when {i} then '{e}'" for i, e in enumerate(endings))
    return f"concat({part(n)}, {part(f'cast(floor({n} / 25) as bigint)')}, {part(f'(cast(floor({n} / 625) as bigint) * 7 + 3)')}, case {n} % {len(endings)} {tail} end)"


def _side(p: str) -> str:
    draws = ", ".join(f"{_draw(i)} as u{i}" for i in range(1, 8))
    pick = lambda u, n: f"cast(floor({n} * {u}) as bigint)"
    numbers = f"{pick('u1 * u1', 1400)} as n1, {pick('u2', 2600)} as n2, {pick('u3 * u3', 5000)} as n3, {pick('u4', 7000)} as n4, {pick('u5 * u5', 300)} as n5, {pick('u6', 60)} as n6, {pick('u7', 200)} as n7"
    return f"""select k, p, {_word("n1", ("", "N", "SON"))} as first, {_word("n2", ("", "NA", "S"))} as middle, {_word("n3", ("SEN", "", "MAN", "BY"))} as last,
    {_word("n4", (" ROAD", " LANE", "", " STREET"))} as street, {_word("n5", ("TON", "FIELD"))} as city, 1940 + n6 as born, 1 + n7 as house
    from (select k, p, {numbers} from (select k, p, {draws} from (select k, {p} as p from (select cast(c_custkey as bigint) as k from customer))))"""


PEOPLE_A = f"""select k as id_a, first, case when k % 11 = 5 then null else middle end as middle, last, case when k % 17 = 3 then null else street end as street, city,
  case when k % 23 = 7 then null else born end as born, house from ({_side("k")})"""
PEOPLE_B = f"""select k + 1000000 as id_b, case when k % 7 = 1 then substr(first, 1, length(first) - 1) else first end as first, case when k % 6 = 3 then null else middle end as middle,
  case when k % 10 = 6 then concat(substr(last, 1, 2), substr(last, 4, 1), substr(last, 3, 1), substr(last, 5)) else last end as last,
  case when k % 5 = 2 then concat(substr(street, 1, length(street) - 2), 'X') else street end as street, city,
  case when k % 9 = 4 then born + 1 when k % 29 = 1 then null else born end as born, case when k % 13 = 5 then house + 2 when k % 31 = 9 then null else house end as house
  from ({_side("case when k % 4 = 0 then k + 2000000 else k end")})"""
WITH = f"with recursive a as ({PEOPLE_A}), b as ({PEOPLE_B})".replace(".0D", ".0::double")
#: That a pair of ids is one person.
TRUE = "id_b - 1000000 = id_a and id_a % 4 <> 0"
