"""Crossed random-intercept models with given sd ratios, as DuckDB SQL.

The mixed-model equations are built term by term from the plays and solved by
conjugate gradients in a recursive query. No code or formula is shared with the library,
which eliminates the largest factor and factorises the rest.
"""

from __future__ import annotations

#: sd of each grouping factor over the residual sd, in declared order.
RATIOS = (0.25, 0.2, 0.1)
#: Steps of the solver; equations are scaled to a unit diagonal.
STEPS = 80


def _numeric(name: str) -> str:
    return f"{{'t': 'x:{name}', 'v': cast(\"{name}\" as double)}}"


def _factor(name: str, reference: str, times: str = "") -> str:
    value = f'cast("{times}" as double)' if times else "1.0"
    return (f"{{'t': 'f:{times}:{name}=' || \"{name}\", "
            f"'v': case when \"{name}\" = {reference} then 0.0 else {value} end}}")


def model_rows(model: str, src: str, y: str, numeric: list[str], groups: list[str],
               factors: dict[str, str | None], crossed: list[tuple[str, str]] = (), where: str = "true") -> str:
    """(run, y, terms) of the plays in which no column of the model is missing.

    A factor without a reference value has its first value in byte order as one.
    """
    cols = [y, *numeric, *factors, *groups]
    whole = f"from {src} where {where} and " + " and ".join(f'"{c}" is not null' for c in cols)
    reference = {n: f"'{r}'" if r else f'(select min("{n}") {whole})' for n, r in factors.items()}
    terms = ["{'t': 'x:1', 'v': 1.0}", *map(_numeric, numeric),
             *(_factor(n, reference[n]) for n in factors), *(_factor(n, reference[n], x) for x, n in crossed),
             *(f"{{'t': 'g:{i}:{g}=' || \"{g}\", 'v': 1.0}}" for i, g in enumerate(groups))]
    return f"""select '{model}' model, "Season", cast("{y}" as double) y, list_filter([{', '.join(terms)}], lambda z: z.v <> 0) terms
 {whole}"""


def equations(rows: str) -> str:
    """(model, Season, i, j, a) of the equations; j = '' holds the right-hand side."""
    penalty = " ".join(f"when starts_with(i, 'g:{k}:') then {1 / r ** 2!r}" for k, r in enumerate(RATIOS))
    return f"""select model, "Season", i, j, s + case when i <> j then 0 {penalty} else 0 end a from (
 select model, "Season", i.t i, j.t j, sum(i.v * j.v) s
 from (select model, "Season", i, unnest(list_append(terms, {{'t': '', 'v': y}})) j
  from (select *, unnest(terms) i from {rows})) group by all)"""


def numbered(eq: str) -> str:
    """Terms with a number, the root of their diagonal and the scaled right-hand side."""
    return f"""select d.model, d."Season", d.i term, row_number() over (order by d.model, d."Season", d.i) id,
 dense_rank() over (order by d.model, d."Season") run, sqrt(d.a) root, b.a / sqrt(d.a) b
 from {eq} d join {eq} b on b.model = d.model and b."Season" = d."Season" and b.i = d.i and b.j = '' where d.i = d.j"""


def scaled(eq: str, terms: str) -> str:
    return f"""select p.id i, q.id j, e.a / (p.root * q.root) a from {eq} e
 join {terms} p on p.model = e.model and p."Season" = e."Season" and p.term = e.i
 join {terms} q on q.model = e.model and q."Season" = e."Season" and q.term = e.j"""


def solved(matrix: str, terms: str) -> str:
    """(model, factor, Season, lv, est, sd) of all random effects; sds are not solved for."""
    return f"""
with recursive cg(k, run, i, x, r, p) as (
 select 0, run, id, cast(0 as double), b, b from {terms}
 union all
 select k + 1, run, i, x2, r2, r2 + coalesce(sum(r2 * r2) over (partition by run) / nullif(rr, 0), 0) * p from (
  select k, run, i, p, rr, x + step * p x2, r - step * q r2 from (
   select *, coalesce(rr / nullif(sum(p * q) over (partition by run), 0), 0) step from (
    select *, sum(r * r) over (partition by run) rr from (
     select max(k) k, max(run) run, a.i, max(case when a.i = a.j then x end) x, max(case when a.i = a.j then r end) r,
      max(case when a.i = a.j then p end) p, sum(a.a * p) q from cg join {matrix} a on a.j = cg.i group by a.i))))
 where k < {STEPS})
select model, regexp_extract(term, '^g:[0-9]:([^=]*)=', 1) factor, "Season", regexp_replace(term, '^g:[0-9]:[^=]*=', '') lv,
 x / root est, cast(0 as double) sd from cg join {terms} t on t.id = cg.i where k = {STEPS} and starts_with(term, 'g:')"""


_SITUATION = ["Home_Ind", "Shotgun_Ind", "No_Huddle_Ind"]
_PASS_GROUPS = ["Passer_ID_Name", "Receiver_ID_Name", "DefensiveTeam"]
_PLACES = {"Receiver_Position": "WR", "PassLocation": None}

MODELS = {
    "air": model_rows("air", "mme_passes", "airWPA_Result", [*_SITUATION, "QBHit", "Rush_EPA_Att"], _PASS_GROUPS, _PLACES),
    "yac": model_rows("yac", "mme_passes", "yacWPA_Result", [*_SITUATION, "QBHit", "AirYards", "Rush_EPA_Att"], _PASS_GROUPS,
                      _PLACES, [("AirYards", "Receiver_Position")]),
    "qb_rush": model_rows("qb_rush", "mme_rushes", "WPA", [*_SITUATION, "Pass_EPA_Att"], ["Rusher_ID_Name", "DefensiveTeam"],
                          {}, where="\"Rusher_Position\" = 'QB'"),
    "main_rush": model_rows("main_rush", "mme_rushes", "WPA", [*_SITUATION, "Pass_EPA_Att"],
                            ["Team_Side_Gap", "Rusher_ID_Name", "DefensiveTeam"], {"Rusher_Position": "RB"},
                            where="\"Rusher_Position\" <> 'QB'"),
}

_RATED = """select x.*, r."Pass_EPA_Att", r."Rush_EPA_Att" from {} x
 left join rates r on r."Season" = x."Season" and r.posteam is not distinct from x.posteam"""

CTES = {
    "mme_passes": _RATED.format("pooled_passes"),
    "mme_rushes": _RATED.format("pooled_rushes"),
    "mme_rows": " union all ".join(f"({sql})" for sql in MODELS.values()),
    "mme_sums": equations("mme_rows"),
    "mme_terms": numbered("mme_sums"),
    "mme_scaled": scaled("mme_sums", "mme_terms"),
    "mme_fit": solved("mme_scaled", "mme_terms"),
}
