"""SQL of the model queries, written from the formulas: weights by their rule, layers as dot products, rounds of
messages as joins on the edge table, attention and family pools as grouped sums."""

from __future__ import annotations

EM = "WITH em AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS h FROM embeddings)"
GRAPH = """, nd AS (SELECT vec_id AS id, label AS kind, vec_id % 7 AS seed, h FROM em),
 ed AS (SELECT src, dst, (src + step) % 12 AS type FROM (SELECT vec_id AS src, vec_id + 1 AS dst, 0 AS step FROM em UNION ALL SELECT vec_id, vec_id * 7 % (SELECT count(*) FROM em), 1 FROM em)
   WHERE dst < (SELECT count(*) FROM em))"""
ACT = {
    "linear": "{0}",
    "relu": "greatest({0}, 0.0::DOUBLE)",
    "sigmoid": "1 / (1 + exp(-({0})))",
    "softplus": "CASE WHEN {0} > 20 THEN {0} ELSE ln(1 + exp({0})) END",
}


def weights(name: str, shapes: list[tuple[str, int, int, int]]) -> str:
    """CTE ``name`` (layer, part, o, w, b): one row per output of each (layer, part, outputs, inputs)."""
    rows = ", ".join(f"('{layer}', {part}, {out}, {n})" for layer, part, out, n in shapes)
    return f""", {name} AS (SELECT layer, part, o, list_transform(range(n), lambda i: ((((o * n + i) * 31 + part * 7 + length(layer) * 11) % 19) - 9) / 60.0::DOUBLE) AS w, o / 100.0::DOUBLE AS b
   FROM (SELECT layer, part, n, unnest(range(outputs)) AS o FROM (VALUES {rows}) AS v(layer, part, outputs, n)))"""


def dense(name: str, source: str, key: str, vector: str, table: str, layer: str, act: str = "linear", part: int = 0) -> str:
    """CTE ``name`` (key, h): activation(W vector + b)."""
    y = ACT[act].format(f"(list_dot_product(w.w, s.{vector}) + w.b)")
    return f", {name} AS (SELECT s.{key}, list({y} ORDER BY w.o) AS h FROM {source} s JOIN {table} w ON w.layer = '{layer}' AND w.part = {part} GROUP BY s.{key})"


def message_round(name: str, source: str, table: str, i: int) -> str:
    """CTE ``name`` (id, seed, h): relu(W_self h + b + mean over in-edges of W_type h_src + b_type)."""
    return f""", {name}m AS (SELECT e.dst, w.o, avg(list_dot_product(w.w, s.h) + w.b) AS m FROM ed e JOIN {source} s ON s.id = e.src JOIN {table} w ON w.layer = 'type{i}' AND w.part = e.type GROUP BY 1, 2),
 {name} AS (SELECT s.id, any_value(s.seed) AS seed, list(greatest(list_dot_product(w.w, s.h) + w.b + coalesce(m.m, 0), 0.0::DOUBLE) ORDER BY w.o) AS h
   FROM {source} s JOIN {table} w ON w.layer = 'self{i}' LEFT JOIN {name}m m ON m.dst = s.id AND m.o = w.o GROUP BY s.id)"""


def message_shapes(dims: list[tuple[int, int]]) -> list[tuple[str, int, int, int]]:
    return [(f"self{i}", 0, o, n) for i, (n, o) in enumerate(dims)] + [(f"type{i}", t, o, n) for i, (n, o) in enumerate(dims) for t in range(12)]


def attention_shapes(width: int, head_dim: int, out: int) -> list[tuple[str, int, int, int]]:
    return [(n, h, head_dim, width) for n in ("q", "k", "v") for h in range(4)] + [("out", 0, out, 4 * head_dim)]


def attention(source: str, table: str, head_dim: int) -> str:
    """CTEs aw (seed, id, head, weight) and ap (seed, h): four heads, the query is the row of the largest id."""
    return f""", al AS (SELECT seed, arg_max(h, id) AS h FROM {source} GROUP BY 1),
 aq AS (SELECT seed, part, list(list_dot_product(w.w, al.h) + w.b ORDER BY o) AS q FROM al JOIN {table} w ON w.layer = 'q' GROUP BY 1, 2),
 ak AS (SELECT s.seed, s.id, w.part, list(list_dot_product(w.w, s.h) + w.b ORDER BY w.o) AS k FROM {source} s JOIN {table} w ON w.layer = 'k' GROUP BY 1, 2, 3),
 sc AS (SELECT seed, id, part, list_dot_product(q, k) / sqrt({head_dim}.0::DOUBLE) AS s FROM aq JOIN ak USING (seed, part)),
 aw AS (SELECT seed, id, part, exp(s - max(s) OVER w) / sum(exp(s - t)) OVER w AS weight FROM (SELECT *, max(s) OVER (PARTITION BY seed, part) AS t FROM sc) WINDOW w AS (PARTITION BY seed, part)),
 av AS (SELECT s.seed, w.part, w.o, sum(aw.weight * (list_dot_product(w.w, s.h) + w.b)) AS v FROM {source} s JOIN {table} w ON w.layer = 'v' JOIN aw ON aw.seed = s.seed AND aw.id = s.id AND aw.part = w.part GROUP BY 1, 2, 3),
 ac AS (SELECT seed, list(v ORDER BY part, o) AS h FROM av GROUP BY 1)""" + dense("ap", "ac", "seed", "h", table, "out")


def unnested(source: str, *keys: str, vector: str = "h") -> str:
    columns = ", ".join(keys)
    return f" SELECT {columns}, pos, round(value, 6) AS value FROM (SELECT {columns}, generate_subscripts({vector}, 1)::INT - 1 AS pos, unnest({vector}) AS value FROM {source})"


MESSAGES = EM + GRAPH + weights("w", message_shapes([(64, 16)])) + message_round("m0", "nd", "w", 0) + unnested("m0", "id")
STACKED = EM + GRAPH + weights("w", message_shapes([(64, 16), (16, 16)])) + message_round("m0", "nd", "w", 0) + message_round("m1", "m0", "w", 1)
STACKED_MESSAGES = STACKED + unnested("m1", "id")
ATTENTION = EM + GRAPH + weights("w", attention_shapes(64, 16, 32)) + attention("nd", "w", 16)
ATTENTION_POOL = ATTENTION + unnested("ap", "seed")
ATTENTION_WEIGHTS = ATTENTION + " SELECT seed, id, round(avg(weight), 6) AS weight FROM aw GROUP BY 1, 2"
GRAPH_EMBEDDING = (
    STACKED + weights("a", attention_shapes(16, 4, 16)) + attention("m1", "a", 4) + weights("p", [("embed", 0, 512, 16)])
    + dense("ge", "ap", "seed", "h", "p", "embed", "relu") + unnested("ge", "seed")
)

# per family: the pool of its kinds as a list per seed
_LISTED = "SELECT seed, list(x ORDER BY pos) AS h FROM (SELECT seed, pos, {pool} AS x FROM {rows} GROUP BY 1, 2) GROUP BY 1"
_FIRST = "(SELECT seed, arg_min(h, id) AS h FROM nd WHERE kind = {kind} GROUP BY 1)"


def family_ctes(families: list[tuple[str, int]]) -> str:
    """One CTE f_<family> (seed, h) each: the projected pool, zeros for a seed whose nodes have none of the kinds."""
    pools = {
        "book_state": _LISTED.format(pool="sum(w * x) / sum(w)", rows="fx JOIN (SELECT id, exp(n - max(n) OVER (PARTITION BY seed)) AS w FROM (SELECT id, seed, sqrt(list_dot_product(h, h)) AS n FROM nd WHERE kind IN (0, 2))) USING (id)"),
        "queue_state": _LISTED.format(pool="sum(x)", rows="(SELECT * FROM fx WHERE kind = 3)"),
        "event_stream": _LISTED.format(pool="sum(w * x) / sum(w)", rows="fx JOIN (SELECT id, 0.9::DOUBLE ** (row_number() OVER (PARTITION BY seed ORDER BY id DESC) - 1) AS w FROM nd WHERE kind IN (4, 5)) USING (id)"),
        "cross_symbol_regime": _LISTED.format(pool="avg(x)", rows="(SELECT * FROM fx WHERE kind IN (0, 8))"),
        "strategy_context": f"SELECT s.seed, list_concat(coalesce(a.h, z.h), coalesce(b.h, z.h)) AS h FROM (SELECT DISTINCT seed FROM nd) s LEFT JOIN {_FIRST.format(kind=9)} a ON a.seed = s.seed LEFT JOIN {_FIRST.format(kind=6)} b ON b.seed = s.seed, (SELECT list_transform(range(64), lambda i: 0.0::DOUBLE) AS h) z",
        "risk_context": _LISTED.format(pool="max(x)", rows="(SELECT * FROM fx WHERE kind IN (7, 8, 9))"),
    }
    out = ", fx AS (SELECT id, kind, seed, generate_subscripts(h, 1) AS pos, unnest(h) AS x FROM nd)"
    out += weights("w", [(n, 0, width, 128 if n == "strategy_context" else 64) for n, width in families])
    for name, width in families:
        out += f", p_{name} AS ({pools[name]})" + dense(f"d_{name}", f"p_{name}", "seed", "h", "w", name, "relu")
        out += f", f_{name} AS (SELECT s.seed, coalesce(h, list_transform(range({width}), lambda i: 0.0::DOUBLE)) AS h FROM (SELECT DISTINCT seed FROM nd) s LEFT JOIN d_{name} d ON d.seed = s.seed)"
    return out


def family(name: str, families: list[tuple[str, int]]) -> str:
    return EM + GRAPH + family_ctes(families) + unnested(f"f_{name}", "seed")


def composed(families: list[tuple[str, int]]) -> str:
    joined = " JOIN ".join([f"f_{families[0][0]}"] + [f"f_{n} USING (seed)" for n, _ in families[1:]])
    lists = ", ".join(f"f_{n}.h" for n, _ in families)
    return EM + GRAPH + family_ctes(families) + f", co AS (SELECT seed, flatten([{lists}]) AS h FROM {joined})" + unnested("co", "seed")


def mlp_shapes(outputs: dict[str, int], width: int = 64, hidden: int = 32) -> list[tuple[str, int, int, int]]:
    return [(f"{n}_{i}", 0, o, k) for n, last in outputs.items() for i, (k, o) in enumerate([(width, hidden), (hidden, last)])]


MLP = EM + weights("w", mlp_shapes({"net": 3})) + dense("l0", "em", "vec_id", "h", "w", "net_0", "relu") + dense("l1", "l0", "vec_id", "h", "w", "net_1", "sigmoid") + unnested("l1", "vec_id")

CONFIDENCE = {
    "mid": "abs(p) / (abs(p) + 1)",
    "probability": "abs(2 * p - 1)",
    "slippage": "1 / (1 + p)",
    "size": "1 - abs(p - 0.5::DOUBLE) * 2",
}


def head_rows(heads: dict[str, tuple[str, int, str]], source: str = "em", key: str = "vec_id", width: int = 64, hidden: int = 32) -> str:
    """CTE hs (key, head_name, value, confidence) of all heads (activation, classes, confidence rule)."""
    out = weights("w", mlp_shapes({n: spec[1] for n, spec in heads.items()}, width, hidden))
    parts = []
    for name, (act, classes, rule) in heads.items():
        out += dense(f"a_{name}", source, key, "h", "w", f"{name}_0", "relu")
        out += dense(f"b_{name}", f"a_{name}", key, "h", "w", f"{name}_1", "linear" if act == "softmax" else act)
        if rule == "class":
            top = "list_max(h)"
            share = f"1 / list_sum(list_transform(h, lambda x: exp(x - {top})))"
            parts.append(f"SELECT {key}, '{name}' AS head_name, (list_position(h, {top}) - 1)::DOUBLE AS value, greatest(0, ({share} - 1 / {classes}.0::DOUBLE) / (1 - 1 / {classes}.0::DOUBLE)) AS confidence FROM b_{name}")
        else:
            parts.append(f"SELECT {key}, '{name}' AS head_name, p AS value, {CONFIDENCE[rule]} AS confidence FROM (SELECT {key}, h[1] AS p FROM b_{name})")
    return out + ", hs AS (" + " UNION ALL ".join(parts) + ")"


def heads(specs: dict[str, tuple[str, int, str]]) -> str:
    return EM + head_rows(specs) + " SELECT vec_id, head_name, round(value, 6) AS value, round(confidence, 6) AS confidence FROM hs"
