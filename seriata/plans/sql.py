"""Pieces of DuckDB SQL that several queries' oracles share: distribution tails, counted draws, resampling."""

from __future__ import annotations

from seriata.functions.draws import DRAW, FACTORS, PLACE

_MASK = "4294967295::ubigint"


def _simpson(upto: str, density: str, steps: int) -> str:
    """Integral of density (of q) from 0 to upto."""
    return f"({upto} / {3.0 * steps} * (select sum(case when i_ in (0, {steps}) then 1 when i_ % 2 = 1 then 4 else 2 end * {density.replace('q', f'({upto} * i_ / {steps}.0)')}) from range({steps + 1}) simpson(i_)))"


def normal_sf(z: str) -> str:
    """Upper tail of the normal distribution."""
    z = f"greatest(least({z}, 14.0), -14.0)"
    return f"(0.5 - {_simpson(z, 'exp(-0.5 * q * q)', 400)} / sqrt(2 * pi()))"


def t_sf(t: str, df: str) -> str:
    """Upper tail of Student's distribution."""
    t = f"greatest(least({t}, 60.0), -60.0)"
    return f"(0.5 - exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt({df} * pi()) * {_simpson(t, f'pow(1 + q * q / {df}, -({df} + 1) / 2.0)', 2000)})"


def t_upper_025(df: str) -> str:
    """The t with an upper tail of 0.025, by its expansion in 1/df; for df of some 100 or more."""
    z = 1.959963984540054
    a = ((z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160)
    return f"({z!r} + " + " + ".join(f"{c!r} / pow({df}, {k + 1})" for k, c in enumerate(a)) + ")"


def mixed(name: str, source: str, expression: str, out: str) -> str:
    """CTEs that end in `name`: source with column out, the mixed 32-bit word of expression."""
    return f"""{name}_1 as (select *, ({expression})::ubigint & {_MASK} as _x from {source}),
{name}_2 as (select * exclude (_x), (xor(_x, _x >> 16) * {FACTORS[0]}::ubigint) & {_MASK} as _x from {name}_1),
{name}_3 as (select * exclude (_x), (xor(_x, _x >> 15) * {FACTORS[1]}::ubigint) & {_MASK} as _x from {name}_2),
{name} as (select * exclude (_x), xor(_x, _x >> 16) as {out} from {name}_3)"""


def seeded(seed: object, *key: str) -> str:
    """draws.seed_of of the columns."""
    return f"('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(key)})), 1, 8))::ubigint"


def words(name: str, source: str, seed: str, draw: str, place: str) -> str:
    """CTEs that end in `name`: source with w, the word of a draw and place."""
    return mixed(f"{name}_e", source, f"{seed} + {draw}::ubigint * {DRAW}::ubigint", "_e") + ",\n" + mixed(name, f"{name}_e", f"_e + {place}::ubigint * {PLACE}::ubigint", "w")


def ranked(name: str, source: str, by: str, **columns: str) -> str:
    """A CTE: source with average ranks of columns within `by`."""
    ranks = ", ".join(f"rank() over (partition by {by} order by {c}) + (count(*) over (partition by {by}, {c}) - 1) / 2.0 as {out}" for out, c in columns.items())
    return f"{name} as (select *, {ranks} from {source})"


def dependence_aware(source: str, key: str, x: str, y: str, cover: int, boots: int, perms: int, seed: object = 0) -> str:
    """CTEs that end in `da`: the row of assoc.dependence_aware for each key of source (key, pos, x, y)."""
    cols = [k.strip() for k in key.split(",")]
    on = " and ".join(f"a.{k} = b.{k}" for k in cols)
    of = lambda t: ", ".join(f"{t}.{k}" for k in cols)
    return f"""da_v as (select {key}, pos, {x} as x, {y} as y from {source}),
da_n0 as (select {key}, count(*) as n from da_v group by {key}),
da_n as (select *, {seeded(seed, *cols)} as s, greatest(1, least(greatest({cover}, (select min(k) from range(1, 100000) t(k) where k * k * k >= da_n0.n)), n // 2)) as b from da_n0),
da_k as (select *, ceil(n / b)::bigint as blocks from da_n),
{ranked('da_r', 'da_v', key, rx='x', ry='y')},
da_u as (select {key}, pos, rx - avg(rx) over (partition by {key}) as ux, ry - avg(ry) over (partition by {key}) as uy from da_r),
da_rho as (select {key}, corr(ux, uy) as rho, sqrt(sum(ux * ux) * sum(uy * uy)) as scale from da_u group by {key}),
da_b0 as (select *, unnest(range(blocks)) as j from (select *, unnest(range({boots})) as d from da_k)),
{words('da_b1', 'da_b0', 's', 'd', 'j')},
da_b2 as (select {key}, n, b, d, j, (w % n)::bigint as start, unnest(range(b)) as i from da_b1),
da_b3 as (select {key}, d, (start + i) % n as src from da_b2 where j * b + i < n),
da_b4 as (select {of('a')}, a.d, b.x, b.y from da_b3 a join da_v b on {on} and a.src = b.pos),
{ranked('da_b5', 'da_b4', key + ', d', rx='x', ry='y')},
da_b6 as (select {key}, d, corr(rx, ry) as rho from da_b5 group by {key}, d),
da_b as (select {key}, quantile_cont(rho, 0.025) as lo, quantile_cont(rho, 0.975) as hi, greatest(2 * least(avg((rho <= 0)::int), avg((rho >= 0)::int)), 1.0 / count(*)) as two, avg(rho) as mean, count(*) as k from da_b6 where not isnan(rho) group by {key}),
da_p0 as (select *, unnest(range(blocks)) as j from (select *, unnest(range({perms})) as d from da_k)),
{words('da_p1', 'da_p0', 's + 2', 'd', 'j')},
da_p2 as (select {key}, n, b, s, d, j, least((j + 1) * b, n) - j * b as size, row_number() over (partition by {key}, d order by w, j) as place from da_p1),
da_p3 as (select *, coalesce(sum(size) over (partition by {key}, d order by place rows between unbounded preceding and 1 preceding), 0)::bigint as dest from da_p2),
{words('da_p4', 'da_p3', 's + 3', 'd', '0')},
da_p5 as (select {key}, n, b, d, j, dest, (w % n)::bigint as turn, unnest(range(size)) as i from da_p4),
da_p6 as (select {key}, d, dest + i as pos, (j * b + i + turn) % n as src from da_p5),
da_p7 as (select {of('a')}, a.d, sum(b.ux * c.uy) as dot from da_p6 a join da_u b on {on} and a.pos = b.pos join da_u c on {on.replace('b.', 'c.')} and a.src = c.pos group by {of('a')}, a.d),
da_p as (select {of('a')}, (1 + sum((abs(a.dot / b.scale) >= abs(b.rho))::int)) / ({perms} + 1.0) as p, count(*) as k from da_p7 a join da_rho b on {on} group by {of('a')}),
da as (select {of('a')}, a.n, r.rho, q.lo, q.hi, case when q.lo * q.hi > 0 then 1 else 0 end as excl, p.p, q.two, q.mean, a.b, a.blocks, q.k as n_boot, p.k as n_perm
  from da_k a join da_rho r on {on.replace('b.', 'r.')} join da_b q on {on.replace('b.', 'q.')} join da_p p on {on.replace('b.', 'p.')})"""


def aot_monte_carlo(source: str, key: str, draws: int, seed: object) -> str:
    """CTEs that end in `mc`: key, n, r, p_perm of diagnose.aot_monte_carlo."""
    cols = [k.strip() for k in key.split(",")]
    on = " and ".join(f"a.{k} = b.{k}" for k in cols)
    return f"""mc_v as (select {key}, pos, value - avg(value) over (partition by {key}) as c, count(*) over (partition by {key}) as n, {seeded(seed, *cols)} as s from {source}),
mc_t as (select {key}, max(n) as n, sum(c * c) as s2 from mc_v group by {key}),
mc_o as (select {key}, c, coalesce(lead(c) over (partition by {key} order by pos), first_value(c) over (partition by {key} order by pos)) as nx from mc_v),
mc_r as (select {', '.join('a.' + k for k in cols)}, max(b.n) as n, max(b.s2) as s2, sum(a.c * a.nx) / max(b.s2) as r from mc_o a join mc_t b on {on} group by {', '.join('a.' + k for k in cols)}),
mc_d as (select {key}, pos, c, s, unnest(range({draws})) as d from mc_v),
{words('mc_w', 'mc_d', 's', 'd', 'pos')},
mc_x as (select {key}, d, c, lead(c) over w as nx, first_value(c) over w as fi from mc_w window w as (partition by {key}, d order by w, pos)),
mc_y as (select {key}, d, sum(c * coalesce(nx, fi)) as num from mc_x group by {key}, d),
mc as (select {', '.join('a.' + k for k in cols)}, max(b.n) as n, max(b.r) as r, (1 + sum((a.num / b.s2 >= b.r - 1e-15)::int)) / ({draws} + 1.0) as p_perm from mc_y a join mc_r b on {on} group by {', '.join('a.' + k for k in cols)})"""


def agreement_monte_carlo(source: str, key: str, draws: int, seed: object) -> str:
    """CTEs that end in `cm`: key, rho_bar, p, null_mean, null_sd of diagnose.agreement_monte_carlo."""
    cols = [k.strip() for k in key.split(",")]
    on = " and ".join(f"a.{k} = b.{k}" for k in cols)
    return f"""{ranked('cm_r', source, key + ', arm', rk='value')},
cm_c as (select {key}, arm, pos, rk - avg(rk) over (partition by {key}, arm) as c, dense_rank() over (partition by {key} order by arm) - 1 as j, {seeded(seed, *cols)} as s from cm_r),
cm_u as (select *, c / sqrt(sum(c * c) over (partition by {key}, arm)) as u, max(j) over (partition by {key}) + 1 as k from cm_c),
cm_o as (select {key}, (sum(t * t) - max(k)) / (max(k) * (max(k) - 1)) as rho, max(k) as k from (select {key}, pos, sum(u) as t, max(k) as k from cm_u group by {key}, pos) group by {key}),
cm_d as (select {key}, arm, pos, u, s, j, k, unnest(range({draws})) as d from cm_u),
{words('cm_w', 'cm_d', 's', '(d * k + j)', 'pos')},
cm_x as (select {key}, d, k, u, row_number() over (partition by {key}, d, j order by w, pos) as spot from cm_w),
cm_y as (select {key}, d, max(k) as k, spot, sum(u) as t from cm_x group by {key}, d, spot),
cm_n as (select {key}, d, (sum(t * t) - max(k)) / (max(k) * (max(k) - 1)) as rho from cm_y group by {key}, d),
cm as (select {', '.join('a.' + k for k in cols)}, max(b.rho) as rho_bar, (1 + sum((a.rho >= b.rho)::int)) / ({draws} + 1.0) as p, avg(a.rho) as null_mean, stddev_samp(a.rho) as null_sd from cm_n a join cm_o b on {on} group by {', '.join('a.' + k for k in cols)})"""
