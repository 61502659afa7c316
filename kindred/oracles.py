"""SQL that tells what the linkage operators should return, written for DuckDB and apart from their code.

Every pair is a row here, EM is a recursive query whose rows are the parameters of each round, and string scores that DuckDB lacks are
recursions over letters. So it suits small tables only.
"""

from __future__ import annotations

from collections.abc import Iterable

#: Levels that a variable of each kind can have, missing apart.
THREE, TWO = (0, 1, 2), (0, 2)


def level(v: str, match: str, partial: str | None = None) -> str:
    more = f" when {partial} then 1" if partial else ""
    return f"case when a.{v} is null or b.{v} is null then 3 when {match} then 2{more} else 0 end"


def jaro_winkler(v: str) -> str:
    s = f"round(jaro_winkler_similarity(a.{v}, b.{v}), 4)"
    return level(v, f"{s} >= 0.92", f"{s} >= 0.88")


def equal(v: str) -> str:
    return level(v, f"a.{v} = b.{v}")


def near(v: str, one: float = 1, two: float = 2) -> str:
    return level(v, f"abs(a.{v} - b.{v}) <= {one}", f"abs(a.{v} - b.{v}) <= {two}")


def em(tag: str, kinds: Iterable[tuple[int, ...]], prior: float = 0.0, weight: float = 0.0, start: float = 0.1, tol: float = 1e-5, address: tuple[int, ...] = (), prior_pi: float = 0.0, w_pi: float = 0.0) -> str:
    """CTEs over {tag}_g(id_a, id_b, gamma_1 ..): {tag}_p (patterns and counts), {tag}_em (parameters by round), {tag}_z (p and zeta, w).

    A round's lists m and u have four places a variable: levels 0 to 2 and missing, which weighs 1. Sums of a variable's levels are put
    in ascending order for matches, in descending order for others.
    """
    kinds = list(kinds)
    k = len(kinds)
    names = ", ".join(f"gamma_{i}" for i in range(1, k + 1))

    def places(values: list[str], kind: tuple[int, ...]) -> str:
        by = dict(zip(kind, values, strict=True))
        return ", ".join([*(by.get(x, "0.0::double") for x in (0, 1, 2)), "1.0::double"])

    first = [[(50.0 * i + 1) / sum(50.0 * j + 1 for j in range(len(kind))) for i in range(len(kind))] for kind in kinds]
    m0 = ", ".join(places([f"{x!r}::double" for x in f], kind) for f, kind in zip(first, kinds, strict=True))
    u0 = ", ".join(places([f"{x!r}::double" for x in reversed(f)], kind) for f, kind in zip(first, kinds, strict=True))
    product = lambda c, s: " * ".join(f"{s}.{c}[{4 * i + 1} + gamma_{i + 1}]" for i in range(k))
    sums = ", ".join(
        f"list_{order}([{', '.join(f'coalesce(sum({what}) filter (where gamma_{i + 1} = {x}), 0.0)' for x in kind)}]) as {c}{i}"
        for i, kind in enumerate(kinds)
        for c, order, what in (("m", "sort", "n * zeta"), ("u", "reverse_sort", "n * (1 - zeta)"))
    )
    pairs = f"(select sum(n) from {tag}_p)"
    mu = f"({prior!r}::double * {weight / (1 - weight)!r} * {pairs} + 1)" if prior and weight else "1.0::double"
    psi = f"({(1 - prior) / prior!r}::double * {mu})" if prior and weight else "1.0::double"
    # an address variable's lowest level gets a0 more matches, each other one a0 * (1 - prior_pi) / prior_pi
    a0 = f"({w_pi / (1 - w_pi)!r}::double * {prior_pi!r} * {prior!r} * {pairs} + 1)"
    more = lambda c, i, j: "" if c == "u" or i not in address else f" + {a0}" + (f" * {(1 - prior_pi) / prior_pi!r}" if j else "")
    value = lambda c, i, j: f"({c}{i}[{j + 1}]{more(c, i, j)})"
    new = lambda c: ", ".join(places([f"{value(c, i, j)} / ({' + '.join(value(c, i, x) for x in range(len(kind)))})" for j in range(len(kind))], kind) for i, kind in enumerate(kinds))
    step = lambda c: f"list_max([abs(x[1] - x[2]) for x in list_zip(new_{c}, {c})])"
    return f"""{tag}_p as (select {names}, count(*) as n, row_number() over (order by {names}) - 1 as pattern_id from {tag}_g group by {names}),
  {tag}_em(r, p_m, m, u, change) as (
    select 1, {start!r}::double, [{m0}], [{u0}], 1e9::double
    union all
    select r + 1, new_p, new_m, new_u, greatest(abs(new_p - p_m), {step("m")}, {step("u")}) from (
      select r, p_m, m, u, (hits + {mu} - 1) / ({psi} - {mu} + pairs) as new_p, [{new("m")}] as new_m, [{new("u")}] as new_u from (
        select r, p_m, m, u, sum(n * zeta) as hits, sum(n) as pairs, {sums} from (
          select r, p_m, m, u, n, {names}, case when x + y > 0 then x / (x + y) else 0 end as zeta from (
            select e.*, p.*, e.p_m * {product("m", "e")} as x, (1 - e.p_m) * {product("u", "e")} as y from {tag}_em e, {tag}_p p where e.change > {tol!r} and e.r <= 5000))
        group by r, p_m, m, u))),
  {tag}_last as (select * from {tag}_em order by r desc limit 1),
  {tag}_z as (select p.*, e.p_m * {product("m", "e")} / (e.p_m * {product("m", "e")} + (1 - e.p_m) * {product("u", "e")}) as zeta, ln({product("m", "e")} / ({product("u", "e")})) as w,
    {product("m", "e")} as like_m, {product("u", "e")} as like_u from {tag}_em e, {tag}_p p where e.r = (select max(r) - 1 from {tag}_em)),
  {tag}_n as (select p.*, like_m / sum(like_m) over () as p_gamma_jm, like_u / sum(like_u) over () as p_gamma_ju from {tag}_z p)"""


def pairs(tag: str, levels: list[str], more: str = "") -> str:
    """CTE {tag}_g: all pairs of a and b with their levels."""
    return f"{tag}_g as (select a.id_a, b.id_b, {', '.join(f'{x} as gamma_{i}' for i, x in enumerate(levels, 1))} from a cross join b{more})"


def on_pattern(tag: str, k: int) -> str:
    return f"{tag}_g g join {tag}_z z on {' and '.join(f'g.gamma_{i} = z.gamma_{i}' for i in range(1, k + 1))}"


def adjusted(tag: str, k: int, variables: list[tuple[int, str, str, float]]) -> str:
    """CTE {tag}_f: every pair with tf_<variable>, final_weight, final_zeta, tf_adjusted. variables: place, name, kind, weight."""
    joins, tf, terms, flags = "", [], [], []
    tables = ""
    for i, v, kind, weight in variables:
        if kind != "numeric":
            for side in "ab":
                tables += f"{tag}_{v}_{side} as (select {v} as v, greatest(count(*) / (select count(*) from {side})::double, 0.001) as tf from {side} where {v} is not null group by {v}), "
                joins += f" left join {tag}_{v}_{side} on {side}.{v} = {tag}_{v}_{side}.v"
            x, y = f"{tag}_{v}_a.tf", f"{tag}_{v}_b.tf"
            denominator = f"({x} + {y}) / 2" if kind == "exact" else f"case when {x} is null or {y} is null then coalesce({x}, {y}) else greatest({x}, {y}) end"
        else:
            denominator = "1.0::double"
        share = lambda g, i=i: f"(select sum(n) filter (where gamma_{i} = {g}) / sum(n)::double from {tag}_p)"
        tf.append(f"{denominator} as tf_{v}")
        terms.append(f"case gamma_{i} when 2 then {weight} * ln({share(2)} / tf_{v}) when 1 then {weight} * ln({share(1)} / tf_{v}) else 0 end")
        flags.append(f"gamma_{i} in (1, 2)")
    return f"""{tables}{tag}_j as (select g.*, z.pattern_id, z.w, {', '.join(tf)} from {on_pattern(tag, k)} join a on a.id_a = g.id_a join b on b.id_b = g.id_b{joins}),
  {tag}_f as (select *, 1 / (1 + exp(-final_weight)) as final_zeta from (
    select *, (select log2(p_m / (1 - p_m)) from {tag}_last) + w + {' + '.join(terms)} as final_weight, {' or '.join(flags)} as tf_adjusted from {tag}_j))"""


def fuzzy(tag: str, v: str) -> str:
    """CTE {tag}(va, vb, score): the bit-mask score of every value of a against every one of b; null without a match."""
    bits = "list_sum([case when vb[k + 1] = c then 1 << k else 0 end for k in range(0, 16)])::bigint"
    low, high = "greatest(0, i - d - 1)", "least(15, i + d + 1)"
    return f"""{tag}_l as (select a.v as va, b.v as vb, regexp_extract_all(a.v, '[A-Z ]') as letters, least(strlen(a.v), 16) as lq, least(strlen(b.v), 16) as lc
    from (select distinct {v} as v from a where {v} is not null) a cross join (select distinct {v} as v from b where {v} is not null) b),
  {tag}_d as (select *, case when lc <= 3 or lc // 2 - 1 <= m then m else lc // 2 - 1 end as d from (select *, case when lq > 3 then lq // 2 - 1 else 0 end as m from {tag}_l)),
  {tag}_s(va, vb, letters, lq, lc, d, i, used, matches, exact, moved) as (
    select va, vb, letters, lq, lc, d, 0::bigint, 0::bigint, 0::bigint, 0::bigint, 0::bigint from {tag}_d
    union all
    select va, vb, letters, lq, lc, d, i, used | bit, matches + (bit > 0)::bigint, exact | (bit & ((1::bigint << i) - 1)), moved + (mask > 0 and bit - 1 < used)::bigint from (
      select *, xor(free & (free - 1), free) as bit from (
        select *, case when i < 16 then mask & ((2::bigint << ({high})::int) - (1::bigint << ({low})::int)) & ~used else 0 end as free from (
          select va, vb, letters, lq, lc, d, i, used, matches, exact, moved, {bits} as mask from (
            select va, vb, letters, lq, lc, d, i + 1 as i, used, matches, exact, moved, letters[i + 1] as c from {tag}_s where i < len(letters)))))),
  {tag}_t as (select *, case when moved > matches / 2 then moved - 1 else moved end as turned,
    case when exact & 15 = 15 then 4 when exact & 7 = 7 then 3 when exact & 3 = 3 then 2 when exact & 1 = 1 then 1 else 0 end as head from {tag}_s where i = len(letters)),
  {tag} as (select va, vb, case when matches > 0 then base + 0.1::double * head * (1 - base) end as score from (
    select *, (matches * (1024 // lc + 1024 // lq) / 1024::double + 1 - turned / nullif(matches, 0)::double) / 3 as base from {tag}_t))"""


def names(v: str) -> str:
    """CTE n(va, vb): every value of a with every one of b."""
    return f"n as (select a.v as va, b.v as vb from (select distinct {v} as v from a) a cross join (select distinct {v} as v from b) b)"


#: CTE s(va, vb, score): optimal string alignment, cell by cell; over[] is the row being filled, after it the ones above.
OSA = """s_(va, vb, i, j, over, one, two) as (
    select va, vb, 1::bigint, 0::bigint, [1::bigint], range(0, length(vb) + 1), range(0, length(vb) + 1) from n
    union all
    select va, vb, case when j = length(vb) then i + 1 else i end, case when j = length(vb) then 0 else j + 1 end,
      case when j = length(vb) then [i + 1] else list_append(over, least(one[j + 2] + 1, over[j + 1] + 1, one[j + 1] + (va[i] <> vb[j + 1])::bigint,
        case when i > 1 and j > 0 and va[i] = vb[j] and va[i - 1] = vb[j + 1] then two[j] + 1 else 1000000 end)) end,
      case when j = length(vb) then over else one end, case when j = length(vb) then one else two end
    from s_ where i <= length(va)),
  s as (select va, vb, 1 - one[length(vb) + 1] / greatest(length(va), length(vb))::double as score from s_ where i = length(va) + 1)"""

#: CTE s(va, vb, score): Ratcliff and Obershelp; todo holds the parts (from, to) of both strings that are still to be matched.
RATCLIFF = """s_(va, vb, todo, common) as (
    select va, vb, [{'a': 1::bigint, 'b': length(va)::bigint, 'c': 1::bigint, 'd': length(vb)::bigint}], 0::bigint from n
    union all
    select va, vb, case when best.n = 0 then todo[2:] else list_concat(todo[2:], [{'a': x.a, 'b': -best.i - 1, 'c': x.c, 'd': -best.j - 1},
      {'a': -best.i + best.n, 'b': x.b, 'c': -best.j + best.n, 'd': x.d}]) end, common + best.n
    from (select *, list_max(list_append(flatten([[{'n': list_max([k for k in range(0, least(x.b - i, x.d - j) + 2) if substr(va, i, k) = substr(vb, j, k)]), 'i': -i, 'j': -j}
      for j in range(x.c, x.d + 1)] for i in range(x.a, x.b + 1)]), {'n': 0::bigint, 'i': 0::bigint, 'j': 0::bigint})) as best
      from (select *, todo[1] as x from s_ where len(todo) > 0))),
  s as (select va, vb, 2 * common / (length(va) + length(vb))::double as score from s_ where len(todo) = 0)"""


def soundex(v: str) -> tuple[str, str]:
    """The code by rules: H and W are passed over, equal neighbouring codes are one, vowels part them; and the form in which H and W part
    a first letter from a later one of its class."""
    classes = [("1", "BFPV"), ("2", "CGJKQSXZ"), ("3", "DT"), ("4", "L"), ("5", "MN"), ("6", "R")]

    def code(s: str) -> str:
        kept = f"concat(substr({s}, 1, 1), regexp_replace(substr({s}, 2), '[HW]', '', 'g'))"
        digits = f"translate({kept}, 'AEIOUYHWBFPVCGJKQSXZDTLMNR ', '00000077111122222222334556')"
        for d in "1234567":
            digits = f"regexp_replace({digits}, '{d}{d}+', '{d}', 'g')"
        return f"concat(substr({s}, 1, 1), substr(concat(replace(substr({digits}, 2), '0', ''), '000'), 1, 3))"

    apart = " or ".join(f"regexp_matches({v}, '^[{g}][HW]+[{g}]')" for _, g in classes)
    return code(v), f"case when {apart} then {code(f'regexp_replace({v}, $q$^(.)[HW]+$q$, $q$\\1A$q$)')} else {code(v)} end"
