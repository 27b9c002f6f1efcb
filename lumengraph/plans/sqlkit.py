"""SQL text of the inputs in tables.py and of shared formulas, for the checks."""

from __future__ import annotations

from lumengraph.plans.tables import NODE_SHARES, NODE_SPREAD


def r(expr: str, places: int = 6) -> str:
    return f"(round({expr} + 3e-11::DOUBLE, {places}) + 0.0)"


def with_(*parts: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + body


_BYTE = "CAST(least(255, greatest(0, floor(127.5 + 255.0 * CAST(embedding[{i}] AS DOUBLE)))) AS INT)"

RASTER = f"""pix AS MATERIALIZED (
  SELECT CAST(vec_id // 50 AS INT) AS image_id, CAST(vec_id % 50 AS INT) AS y, CAST(t.i AS INT) AS x,
    {_BYTE.format(i='t.i + 1')} AS r, {_BYTE.format(i='(t.i + 21) % 64 + 1')} AS g, {_BYTE.format(i='(t.i + 42) % 64 + 1')} AS b
  FROM embeddings, range(0, 64) AS t(i)),
dims AS (SELECT image_id, max(y) + 1 AS h, 64 AS w FROM pix GROUP BY image_id)"""

DISCS = """disc0 AS (
  SELECT CAST(s_suppkey AS INT) AS image_id, CAST(ty.i AS INT) AS y, CAST(tx.i AS INT) AS x,
    (tx.i-32)*(tx.i-32)+(ty.i-32)*(ty.i-32) AS far, CAST(s_suppkey AS INT) AS k
  FROM supplier, range(0, 64) AS ty(i), range(0, 64) AS tx(i)),
disc1 AS (
  SELECT *, far <= (k%16+8)*(k%16+8) AS mask,
    ((far <= (k%16+8)*(k%16+8)) AND NOT (k%4=1 AND far <= 9))
      OR (k%3=2 AND x BETWEEN 3 AND 7 AND y BETWEEN 3 AND 7) AS dark,
    CASE WHEN k%7=0 THEN 0 ELSE x*7+y*13 END AS grain
  FROM disc0),
pix AS MATERIALIZED (
  SELECT image_id, y, x, mask,
    CAST(CASE WHEN dark THEN 90+grain%32 WHEN k%5=3 THEN 60 ELSE 220 END AS INT) AS r,
    CAST(CASE WHEN dark THEN 50+grain%27 WHEN k%5=3 THEN 160 ELSE 170 END AS INT) AS g,
    CAST(CASE WHEN dark THEN 30+grain%23 WHEN k%5=3 THEN 220 ELSE 140 END AS INT) AS b,
    CAST((y // 16) * 4 + x // 16 AS INT) AS seg
  FROM disc1),
dims AS (SELECT DISTINCT image_id, 64 AS h, 64 AS w FROM pix)"""

_SHARES = ",\n    ".join(
    f"list_reduce(list_transform(embedding[{first}:{first + n - 1}], lambda v: CAST(v AS DOUBLE)), lambda p, q: p + q) * {by}::DOUBLE / {NODE_SPREAD}::DOUBLE AS {name}"
    for name, (first, n, by) in NODE_SHARES.items()
)
NODES = f"""nodes AS MATERIALIZED (
  SELECT CAST(vec_id // 20 AS INT) AS image_id, CAST(vec_id % 20 AS INT) AS node,
    {_SHARES}
  FROM embeddings)"""


def similarity(p: str, q: str) -> str:
    return (
        f"(0.7*(1-least(sqrt(({p}.l-{q}.l)*({p}.l-{q}.l)+({p}.a-{q}.a)*({p}.a-{q}.a)+({p}.b-{q}.b)*({p}.b-{q}.b))/100.0,1.0))"
        f"+0.3*(1-least(sqrt(({p}.cy-{q}.cy)*({p}.cy-{q}.cy)+({p}.cx-{q}.cx)*({p}.cx-{q}.cx))/sqrt(2.0),1.0)))"
    )


EDGES = (
    NODES
    + f""",
edges AS MATERIALIZED (
  SELECT p.image_id, p.node AS src, q.node AS dst, {similarity('p', 'q')} AS weight
  FROM nodes p JOIN nodes q ON p.image_id = q.image_id AND p.node < q.node
  WHERE {similarity('p', 'q')} > 0.75),
arcs AS MATERIALIZED (
  SELECT image_id, src AS u, dst AS v, weight AS w FROM edges
  UNION ALL SELECT image_id, dst, src, weight FROM edges),
deg AS MATERIALIZED (
  SELECT n.image_id, n.node, count(a.v) AS d, coalesce(sum(a.w), 0) AS s
  FROM nodes n LEFT JOIN arcs a ON n.image_id = a.image_id AND n.node = a.u GROUP BY n.image_id, n.node)"""
)

SCORED = """scored AS MATERIALIZED (
  SELECT l.doc_id, l.quality AS label, (d.n_chars % 1000) / 1000.0::DOUBLE AS score,
    CAST((d.n_chars % 1000) / 1000.0::DOUBLE > 0.5 AS INT) AS prediction, CAST(l.doc_id % 5 AS INT) AS fold, d.lang
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""

FEATURES = """feat AS MATERIALIZED (
  SELECT vec_id, CAST(label % 2 AS DOUBLE) AS label, 'f' || CAST(t.i AS VARCHAR) AS name,
    CAST(embedding[t.i + 1] AS DOUBLE) AS value
  FROM embeddings, range(0, 64) AS t(i))"""

META = """meta AS (
  SELECT 'D' || CAST(doc_id AS VARCHAR) AS isic_id,
    CASE doc_id % 3 WHEN 0 THEN 'Benign' WHEN 1 THEN 'Malignant' ELSE 'Other' END AS diagnosis_1 FROM documents),
files AS (SELECT 'D' || CAST(doc_id AS VARCHAR) || '.jpg' AS filename FROM labels)"""

RECORDS = """rec AS MATERIALIZED (
  SELECT CAST(event_id AS VARCHAR) AS analysis_id, 'img_' || CAST(user_id AS VARCHAR) || '.jpg' AS filename,
    ts AS timestamp, value / (value + 100.0) AS probability,
    CAST(value / (value + 100.0) > 0.5 AS INT) AS predicted_class, event_type AS batch
  FROM events)"""

# --- formulas -------------------------------------------------------------------------------


def lab(rr: str, gg: str, bb: str) -> tuple[str, str, str]:
    lin = lambda c: f"(CASE WHEN {c} > 0.04045 THEN pow(({c} + 0.055) / 1.055, 2.4) ELSE {c} / 12.92 END)"
    curve = lambda t: f"(CASE WHEN {t} > 0.008856 THEN cbrt({t}) ELSE 7.787 * {t} + 16.0 / 116.0 END)"
    matrix = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
    white = (0.95047, 1.0, 1.08883)
    fx, fy, fz = (
        curve(f"(({lin(rr)}*{m[0]}::DOUBLE+{lin(gg)}*{m[1]}::DOUBLE+{lin(bb)}*{m[2]}::DOUBLE)/{w}::DOUBLE)")
        for m, w in zip(matrix, white)
    )
    return f"({fy}*116.0-16.0)", f"(({fx}-{fy})*500.0)", f"(({fy}-{fz})*200.0)"


def hsv(rr: str, gg: str, bb: str) -> tuple[str, str, str]:
    top, low = f"greatest({rr},{gg},{bb})", f"least({rr},{gg},{bb})"
    span = f"({top}-{low})"
    hue = (
        f"(CASE WHEN {span} = 0 THEN 0.0 ELSE (CASE WHEN {bb}={top} THEN ({rr}-{gg})/{span}+4.0 "
        f"WHEN {gg}={top} THEN ({bb}-{rr})/{span}+2.0 WHEN {gg}<{bb} THEN ({gg}-{bb})/{span}+6.0 ELSE ({gg}-{bb})/{span} END)/6.0 END)"
    )
    return hue, f"(CASE WHEN {span} = 0 THEN 0.0 ELSE {span}/{top} END)", top


def hsv8(rr: str, gg: str, bb: str) -> tuple[str, str, str]:
    top, low = f"greatest({rr},{gg},{bb})", f"least({rr},{gg},{bb})"
    span = f"({top}-{low})"
    sat = f"(CASE WHEN {top}=0 THEN 0 ELSE CAST(floor(({span}*round_even(1044480.0/{top},0)+2048)/4096) AS INT) END)"
    turn = f"(CASE WHEN {rr}={top} THEN {gg}-{bb} WHEN {gg}={top} THEN {bb}-{rr}+{span}*2 ELSE {rr}-{gg}+{span}*4 END)"
    raw = f"CAST(floor(({turn}*round_even(122880.0/{span},0)+2048)/4096) AS INT)"
    hue = f"(CASE WHEN {span}=0 THEN 0 WHEN {raw} < 0 THEN {raw}+180 ELSE {raw} END)"
    return hue, sat, top


GRAY = "(r/255.0::DOUBLE*0.2125::DOUBLE+g/255.0::DOUBLE*0.7154::DOUBLE+b/255.0::DOUBLE*0.0721::DOUBLE)"
GRAY8 = "((r*9798+g*19235+b*3735+16384)>>15)"


def mirror(pos: str, size: str) -> str:
    """Reflect without repeating the border pixel."""
    return f"(CASE WHEN {pos} < 0 THEN -({pos}) WHEN {pos} >= {size} THEN 2*({size}-1)-({pos}) ELSE {pos} END)"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    def lit(v: object) -> str:
        if isinstance(v, str):
            return "'" + v + "'"
        return f"{v!r}::DOUBLE" if isinstance(v, float) else str(v)

    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def stencil(name: str, source: str, value: str, kernels: dict[str, list[list[float]]]) -> str:
    """Correlation of pixel table ``source`` with kernels; needs ``dims``."""
    taps: dict[tuple[int, int], dict[str, float]] = {}
    for key, kernel in kernels.items():
        k = len(kernel) // 2
        for j, row in enumerate(kernel):
            for i, w in enumerate(row):
                if w:
                    taps.setdefault((j - k, i - k), {})[key] = float(w)
    rows = [(dy, dx, *[found.get(key, 0.0) for key in kernels]) for (dy, dx), found in sorted(taps.items())]
    cols = ", ".join(f"k_{key}" for key in kernels)
    sums = ", ".join(f"sum(q.{value} * t.k_{key}) AS {key}" for key in kernels)
    return (
        values(f"taps_{name}", f"dy, dx, {cols}", rows)
        + f""",
to_{name} AS MATERIALIZED (
  SELECT p.image_id, p.y, p.x, {mirror('p.y + t.dy', 's.h')} AS qy, {mirror('p.x + t.dx', 's.w')} AS qx, t.*
  FROM {source} p JOIN dims s ON p.image_id = s.image_id CROSS JOIN taps_{name} t),
{name} AS MATERIALIZED (
  SELECT t.image_id, t.y, t.x, {sums}
  FROM to_{name} t JOIN {source} q ON q.image_id = t.image_id AND q.y = t.qy AND q.x = t.qx
  GROUP BY t.image_id, t.y, t.x)"""
    )
