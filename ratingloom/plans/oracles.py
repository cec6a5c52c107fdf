"""The SQL that checks each registered query: plain long-form SQL over the same tables."""

from __future__ import annotations

from ratingloom.functions import vectors as V
from ratingloom.operators import ppc, prepare
from ratingloom.plans.catalog import ITERATIONS, K, LAM, MOST_ITERATIONS, SAMPLE, TOLERANCE, TOP

EVENTS = """ratings AS MATERIALIZED (
  SELECT CAST(json_extract_string(props, '$.k') AS INT) AS item, CAST(user_id AS INT) AS "user",
         CASE event_type WHEN 'error' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3
                         WHEN 'signup' THEN 4 ELSE 5 END AS rating, event_id AS seq
  FROM events)"""

ORDERS = """ratings AS MATERIALIZED (
  SELECT CAST(l_suppkey AS INT) AS item, CAST(o_custkey AS INT) AS "user",
         CAST(ceil(l_quantity / 10) AS INT) AS rating, l_orderkey * 10 + l_linenumber AS seq
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

SLOT = (f"((seq % 100) * {prepare.SPLIT_FACTOR} + {prepare.SPLIT_SHIFT}) % 100 "
        f"< {prepare.TRAIN_PERCENT}")

TRAIN = f"""{EVENTS.replace('ratings AS', 'everything AS')},
ratings AS MATERIALIZED (SELECT * FROM everything WHERE {SLOT})"""

VECTORS = """vectors AS (
  SELECT vec_id AS id, unnest(embedding)::DOUBLE AS v,
         CAST(unnest(range(len(embedding))) AS INT) AS j FROM embeddings)"""


def sql(body: str, *parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + body


def uniform(name: str, id_col: str, seed: int) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT {id_col}, CAST(j AS INT) AS j,
         ((x * x * {V.INIT_SQUARE} + x * {V.INIT_CROSS} * (j + 1) + j * {V.INIT_COLUMN}
           + {seed * V.INIT_SEED} + q * {V.INIT_WRAP}) % {V.INIT_MODULUS} + 1) / CAST({V.INIT_MODULUS + 1} AS DOUBLE) AS v
  FROM (SELECT DISTINCT {id_col}, CAST({id_col} AS BIGINT) % {V.INIT_MODULUS} AS x,
          CAST({id_col} AS BIGINT) // {V.INIT_MODULUS} % {V.INIT_MODULUS} AS q FROM ratings)
  CROSS JOIN (SELECT range AS j FROM range({K})))"""


H0 = f"""{uniform('u0', '"user"', ppc.H_SEED)},
heads AS (SELECT "user", j, v / sum(v) OVER (PARTITION BY "user") AS v FROM u0),
h0 AS MATERIALIZED (
  SELECT "user", j, CASE WHEN j < {K - 1} THEN v
         ELSE 1 - sum(CASE WHEN j < {K - 1} THEN v ELSE 0 END) OVER (PARTITION BY "user") END AS v
  FROM heads)"""

W0 = uniform("w0", "item", ppc.W_SEED)


def weighted(name: str, factors: str, key: str, by: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT r.{by}, f.j, sum(r.rating * f.v) AS v
  FROM ratings r JOIN {factors} f ON r.{key} = f.{key} GROUP BY r.{by}, f.j)"""


def gram(name: str, factors: str, key: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v
  FROM {factors} a JOIN {factors} b ON a.{key} = b.{key} GROUP BY a.j, b.j)"""


def product(name: str, factors: str, matrix: str, key: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT f.{key}, g.j, sum(f.v * g.v) AS v
  FROM {factors} f JOIN {matrix} g ON f.j = g.i GROUP BY f.{key}, g.j)"""


def h_pass(t: int, variant: str = "scalar") -> str:
    """H number t from H and W number t - 1."""
    h, w = f"h{t - 1}", f"w{t - 1}"
    if variant == "scalar":
        dots = f"""SELECT "user", j, hv, xv, yv, sum(hv * yv) OVER (PARTITION BY "user") AS d,
         sum(hv * xv) OVER (PARTITION BY "user") AS e FROM all{t}"""
    else:
        dots = f"""SELECT "user", j, hv, xv, yv, hv * yv AS d, hv * xv AS e FROM all{t}"""
    return ",\n".join([
        weighted(f"x{t}", w, "item", '"user"'), gram(f"b{t}", w, "item"),
        product(f"y{t}", h, f"b{t}", '"user"'),
        f"""all{t} AS (SELECT h."user", h.j, h.v AS hv, x.v AS xv, y.v AS yv FROM {h} h
  JOIN x{t} x ON h."user" = x."user" AND h.j = x.j
  JOIN y{t} y ON h."user" = y."user" AND h.j = y.j)""",
        f"""h{t} AS MATERIALIZED (SELECT "user", j, hv * (xv + d) / (yv + e) AS v FROM ({dots}))""",
    ])


def w_pass(t: int, h: str | None = None) -> str:
    """W number t from W number t - 1 and H number t."""
    h, w = h or f"h{t}", f"w{t - 1}"
    return ",\n".join([
        weighted(f"s{t}", h, '"user"', "item"), gram(f"c{t}", h, '"user"'),
        product(f"t{t}", w, f"c{t}", "item"),
        f"""w{t} AS MATERIALIZED (SELECT w.item, w.j, w.v * s.v / t.v AS v FROM {w} w
  JOIN s{t} s ON w.item = s.item AND w.j = s.j JOIN t{t} t ON w.item = t.item AND w.j = t.j)""",
    ])


def fit(n: int) -> str:
    parts = [H0, W0]
    for t in range(1, n + 1):
        parts += [h_pass(t), w_pass(t)]
    return ",\n".join(parts)


#: All passes, the change of H in each, and the pass that a tolerance stops at.
CHANGES = f"""passes AS ({" UNION ALL ".join(
    f'SELECT "user", j, v, {t} AS passes FROM h{t}' for t in range(1, MOST_ITERATIONS + 1))}),
changes AS ({" UNION ALL ".join(
    f'SELECT {t} AS t, sqrt(sum((a.v - b.v) * (a.v - b.v))) AS delta FROM h{t - 1} a '
    f'JOIN h{t} b ON a."user" = b."user" AND a.j = b.j' for t in range(1, MOST_ITERATIONS + 1))}),
stop AS (SELECT CAST(coalesce(min(t), {MOST_ITERATIONS}) AS INT) AS passes FROM changes
  WHERE delta < {TOLERANCE})"""

CLUSTERS = f"""{fit(ITERATIONS)},
best AS (SELECT "user", j, round(v, 9) AS v, max(round(v, 9)) OVER (PARTITION BY "user") AS top
  FROM h{ITERATIONS}),
clusters AS MATERIALIZED (
  SELECT "user", CAST(min(j) AS INT) AS cluster FROM best WHERE v = top GROUP BY "user")"""

PROBS = f"""{CLUSTERS},
totals AS (SELECT "user", sum(rating) AS total FROM ratings GROUP BY "user"),
item_p AS (SELECT item, sum(rating) / CAST((SELECT sum(rating) FROM ratings) AS DOUBLE) AS p
  FROM ratings GROUP BY item),
pairs AS (SELECT "user", item, arg_max(rating, seq) AS rating, min(seq) AS first_seq
  FROM ratings GROUP BY "user", item),
probs AS MATERIALIZED (
  SELECT c.cluster, p."user", p.item, p.first_seq,
         (1 - {LAM}::DOUBLE) * p.rating / CAST(t.total AS DOUBLE) + {LAM}::DOUBLE * i.p AS p
  FROM pairs p JOIN clusters c ON p."user" = c."user" JOIN totals t ON p."user" = t."user"
  JOIN item_p i ON p.item = i.item)"""

COOC = f"""{PROBS},
g AS MATERIALIZED (SELECT a.cluster, a.item AS i, b.item AS j, sum(a.p * b.p) AS g
  FROM probs a JOIN probs b ON a."user" = b."user" GROUP BY a.cluster, a.item, b.item)"""

SCORES = f"""{COOC},
degree AS (SELECT "user", count(*) AS n FROM probs GROUP BY "user"),
scores AS MATERIALIZED (
  SELECT p.cluster, p."user", g.i AS item, round(sum(ln(g.g)), 6) AS log_score
  FROM probs p JOIN g ON p.cluster = g.cluster AND p.item = g.j
  JOIN degree d ON p."user" = d."user"
  GROUP BY p.cluster, p."user", g.i, d.n HAVING count(*) = d.n)"""

TOPK = f"""{SCORES},
ranked AS (SELECT "user", item, log_score, CAST(row_number() OVER (
    PARTITION BY "user" ORDER BY log_score DESC, item) AS INT) AS rank FROM scores),
topk AS MATERIALIZED (SELECT * FROM ranked WHERE rank <= {TOP})"""

TOPK_UNSEEN = TOPK.replace('AS rank FROM scores)', """AS rank FROM scores s
  WHERE NOT EXISTS (SELECT 1 FROM ratings r WHERE r."user" = s."user" AND r.item = s.item))""")

RELEVANT_UNSEEN = f"""relevant AS (SELECT DISTINCT "user", item FROM everything e WHERE NOT ({SLOT})
  AND NOT EXISTS (SELECT 1 FROM everything t WHERE t."user" = e."user" AND t.item = e.item
                  AND {SLOT.replace('seq', 't.seq')}))"""

RELEVANT = f"""relevant AS (SELECT DISTINCT "user", item FROM everything WHERE NOT ({SLOT}))"""

PRECISION = f"""{TOPK},
{RELEVANT},
per_user AS (
  SELECT t."user", count(r.item) AS hits, count(r.item) / CAST({TOP} AS DOUBLE) AS precision
  FROM topk t LEFT JOIN relevant r ON t."user" = r."user" AND t.item = r.item GROUP BY t."user")"""


PRECISION_UNSEEN = PRECISION.replace(TOPK, TOPK_UNSEEN).replace(RELEVANT, RELEVANT_UNSEEN)

#: Without an arrival order the highest rating of a pair counts as its last.
TOPK_TRIPLES = TOPK.replace("arg_max(rating, seq) AS rating, min(seq)", "max(rating) AS rating, NULL")


def matrix(table: str, id_col: str, digits: int = 6) -> str:
    return f"SELECT {id_col}, j, round(v, {digits}) + 0.0::DOUBLE AS v FROM {table}"


def flat(table: str) -> str:
    return f"SELECT CAST(i * {K} + j AS INT) AS pos, round(v, 6) AS v FROM {table}"


def numbered(column: str, order: str) -> str:
    name = column.strip('"')
    return f"""{name}_index AS (SELECT {column}, CAST(row_number() OVER (ORDER BY first, {column}) - 1
    AS INT) AS idx FROM (SELECT {column}, min({order}) AS first FROM ratings GROUP BY {column}))"""


def reindexed(columns: str, where: str = "") -> str:
    return f"""SELECT i.idx AS item, u.idx AS "user", r.rating{columns}
FROM ratings r JOIN item_index i ON r.item = i.item JOIN user_index u ON r."user" = u."user"
{where}"""


BLOCK_ORDER = """ratings AS MATERIALIZED (SELECT item, "user", rating,
    row_number() OVER (ORDER BY item, seq) AS seq FROM raw)"""

TOP_CLUSTER = """pairs_c AS (SELECT DISTINCT cluster, item, log_score FROM scores),
ranked_c AS (SELECT cluster, item, log_score, CAST(row_number() OVER (
    PARTITION BY cluster ORDER BY log_score DESC, item) AS INT) AS rank FROM pairs_c)"""

TRIPLES = 'SELECT item, "user", rating FROM ratings'
TOTAL_USER = 'SELECT "user", CAST(sum(rating) AS BIGINT) AS total FROM ratings GROUP BY "user"'
TOTAL_ITEM = "SELECT item, CAST(sum(rating) AS BIGINT) AS total FROM ratings GROUP BY item"
ITEM_P = """SELECT item, round(sum(rating) / CAST((SELECT sum(rating) FROM ratings) AS DOUBLE), 9)
AS p FROM ratings GROUP BY item"""

ORACLES: dict[str, str] = {
    "ratings_scan": sql(TRIPLES, EVENTS),
    "ratings_scan_shifted": sql(
        'SELECT item - 1 AS item, "user" - 1 AS "user", rating FROM ratings', EVENTS),
    "parse_blocks": sql(TRIPLES, EVENTS),
    "first_n_sample": sql(
        f'SELECT * FROM ratings ORDER BY seq, item, "user", rating LIMIT {SAMPLE}', ORDERS),
    "reindex_users": sql(
        'SELECT r.item, u.idx AS "user", r.rating, r.seq FROM ratings r '
        'JOIN user_index u ON r."user" = u."user"', EVENTS, numbered('"user"', "seq")),
    "reindex_both": sql(
        reindexed(", r.seq"), EVENTS, numbered('"user"', "seq"), numbered("item", "seq")),
    "reindex_increment": sql(
        reindexed(", r.seq"), EVENTS, numbered('"user"', "seq"), numbered("item", "seq")),
    "ratings_scan_new_files": sql(
        'SELECT item, "user", rating, row_number() OVER (ORDER BY seq) - 1 AS seq FROM ratings', EVENTS),
    "id_cardinalities_sketch": sql(
        'SELECT count(DISTINCT "user") AS n_users, count(DISTINCT item) AS n_items FROM ratings',
        EVENTS),
    "exact_split": sql(
        f"""SELECT item, "user", rating, seq, CAST(row_number() OVER (ORDER BY
    ('0x' || substr(md5(seq::VARCHAR || ':0'), 1, 12))::BIGINT, seq, item, "user", rating)
    <= ceil({prepare.TEST_SHARE} * count(*) OVER ()) AS INT) AS is_test FROM ratings""", EVENTS),
    "id_cardinalities": sql(
        'SELECT count(DISTINCT "user") AS n_users, count(DISTINCT item) AS n_items FROM ratings',
        EVENTS),
    "train_split": sql(f"SELECT * FROM ratings WHERE {SLOT}", EVENTS),
    "test_split": sql(f"SELECT * FROM ratings WHERE NOT ({SLOT})", EVENTS),
    "prepare_full": sql(
        reindexed("", where=f"""WHERE (((r."user"::BIGINT * 31 + r.item) % 100)
            * {prepare.SPLIT_FACTOR} + {prepare.SPLIT_SHIFT}) % 100 < {prepare.TRAIN_PERCENT}"""),
        EVENTS.replace("ratings AS", "raw AS"), BLOCK_ORDER,
        numbered('"user"', "seq"), numbered("item", "seq")),
    "prepare_small": sql(
        reindexed(", r.seq", where=f"WHERE {SLOT}"), ORDERS.replace("ratings AS", "raw AS"),
        'ratings AS MATERIALIZED (SELECT * FROM raw ORDER BY seq, item, "user", rating '
        f'LIMIT {SAMPLE})',
        numbered('"user"', "seq"), numbered("item", "seq")),
    "init_w": sql(matrix("w0", "item", 9), EVENTS, W0),
    "row_normalize": sql(matrix("h0", '"user"', 9), EVENTS, H0),
    "init_h": sql(matrix("h0", '"user"', 9), EVENTS, H0),
    "ppc_x": sql(matrix("x1", '"user"'), EVENTS, W0, weighted("x1", "w0", "item", '"user"')),
    "ppc_x_orders": sql(
        matrix("x1", '"user"'), ORDERS, W0, weighted("x1", "w0", "item", '"user"')),
    "gram_w": sql(flat("b1"), EVENTS, W0, gram("b1", "w0", "item")),
    "ppc_y": sql(matrix("y1", '"user"'), EVENTS, H0, W0, gram("b1", "w0", "item"),
                 product("y1", "h0", "b1", '"user"')),
    "ppc_update_h": sql(matrix("h1", '"user"', 9), EVENTS, H0, W0, h_pass(1)),
    "ppc_update_h_elementwise": sql(
        matrix("h1", '"user"', 9), EVENTS, H0, W0, h_pass(1, "elementwise")),
    "ppc_s": sql(matrix("s1", "item"), EVENTS, H0, weighted("s1", "h0", '"user"', "item")),
    "ppc_s_orders": sql(matrix("s1", "item"), ORDERS, H0, weighted("s1", "h0", '"user"', "item")),
    "gram_h": sql(flat("c1"), EVENTS, H0, gram("c1", "h0", '"user"')),
    "ppc_t": sql(matrix("t1", "item"), EVENTS, H0, W0, gram("c1", "h0", '"user"'),
                 product("t1", "w0", "c1", "item")),
    "ppc_update_w": sql(matrix("w1", "item", 9), EVENTS, H0, W0, w_pass(1, "h0")),
    "ppc_iter1_h": sql(matrix("h1", '"user"', 8), EVENTS, H0, W0, h_pass(1)),
    "ppc_iter1_w": sql(matrix("w1", "item", 8), EVENTS, fit(1)),
    "ppc_iter2_h": sql(matrix("h2", '"user"', 8), EVENTS, fit(1), h_pass(2)),
    "ppc_resume_h": sql(matrix("h2", '"user"', 8), EVENTS, fit(1), h_pass(2)),
    "ppc_tol_h": sql(
        'SELECT "user", j, round(v, 8) + 0.0::DOUBLE AS v, passes FROM passes JOIN stop USING (passes)',
        EVENTS, fit(MOST_ITERATIONS), CHANGES),
    "ppc_delta": sql(
        'SELECT round(sqrt(sum((a.v - b.v) * (a.v - b.v))), 6) AS delta FROM h0 a JOIN h1 b '
        'ON a."user" = b."user" AND a.j = b.j', EVENTS, H0, W0, h_pass(1)),
    "assign_clusters": sql("SELECT * FROM clusters", EVENTS, CLUSTERS),
    "cluster_sizes": sql(
        "SELECT cluster, count(*) AS n_users FROM clusters GROUP BY cluster", EVENTS, CLUSTERS),
    "user_totals": sql(TOTAL_USER, EVENTS),
    "user_totals_orders": sql(TOTAL_USER, ORDERS),
    "global_total": sql("SELECT CAST(sum(rating) AS BIGINT) AS total FROM ratings", EVENTS),
    "item_totals": sql(TOTAL_ITEM, EVENTS),
    "item_probs": sql(ITEM_P, EVENTS),
    "item_probs_orders": sql(ITEM_P, ORDERS),
    "ratings_by_cluster": sql(
        'SELECT c.cluster, r."user", r.item, r.rating, r.seq FROM ratings r '
        'JOIN clusters c ON r."user" = c."user"', EVENTS, CLUSTERS),
    "totals_by_cluster": sql(
        'SELECT c.cluster, r."user", CAST(sum(r.rating) AS BIGINT) AS total FROM ratings r '
        'JOIN clusters c ON r."user" = c."user" GROUP BY c.cluster, r."user"', EVENTS, CLUSTERS),
    "candidate_pairs": sql(
        'SELECT c.cluster, c."user", i.item FROM clusters c '
        "CROSS JOIN (SELECT DISTINCT item FROM ratings) i", EVENTS, CLUSTERS),
    "user_item_prob": sql(
        'SELECT cluster, "user", item, round(p, 9) AS p FROM probs', EVENTS, PROBS),
    "cluster_cooccurrence": sql(
        "SELECT cluster, i, j, round(g, 9) AS g FROM g WHERE i <= j AND g > 0", EVENTS, COOC),
    "rm2_scores": sql("SELECT * FROM scores", EVENTS, SCORES),
    "rm2_from_store": sql("SELECT * FROM scores", EVENTS, SCORES),
    "scores_of_cluster": sql(
        "SELECT * FROM scores WHERE cluster = (SELECT arg_min(cluster, \"user\") FROM probs)", EVENTS, SCORES),
    "rm2_scores_dense": sql(
        'SELECT c.cluster, c."user", i.item, s.log_score FROM clusters c '
        "CROSS JOIN (SELECT DISTINCT item FROM ratings) i "
        'LEFT JOIN scores s ON c."user" = s."user" AND i.item = s.item', EVENTS, SCORES),
    "rm2_last_item": sql(
        'SELECT l.cluster, l."user", g.i AS item, round(ln(g.g), 6) AS log_score FROM ('
        'SELECT cluster, "user", arg_max(item, first_seq) AS j FROM probs GROUP BY 1, 2) l '
        "JOIN g ON l.cluster = g.cluster AND l.j = g.j", EVENTS, COOC),
    "topk_per_user": sql("SELECT * FROM topk", TRAIN, TOPK),
    "topk_per_cluster": sql(
        f"SELECT * FROM ranked_c WHERE rank <= {TOP}", TRAIN, SCORES, TOP_CLUSTER),
    "topk_user_cluster": sql(
        f"SELECT * FROM ranked_c WHERE rank <= {TOP} AND cluster IN (SELECT cluster FROM scores "
        'WHERE "user" = (SELECT min("user") FROM scores))', TRAIN, SCORES, TOP_CLUSTER),
    "topk_item_list": sql(
        'SELECT "user", CAST(rank - 1 AS INT) AS place, item FROM topk', TRAIN, TOPK),
    "relevant_items": sql(
        'SELECT "user", item FROM relevant', EVENTS.replace("ratings AS", "everything AS"),
        RELEVANT),
    "precision_per_user": sql(
        'SELECT "user", hits, round(precision, 6) AS precision FROM per_user', TRAIN, PRECISION),
    "precision_at_k": sql(
        "SELECT round(avg(precision), 9) AS precision_at_k FROM per_user", TRAIN, PRECISION),
    "topk_unseen": sql("SELECT * FROM topk", TRAIN, TOPK_UNSEEN),
    "relevant_items_unseen": sql(
        'SELECT "user", item FROM relevant', EVENTS.replace("ratings AS", "everything AS"),
        RELEVANT_UNSEEN),
    "precision_at_k_unseen": sql(
        "SELECT round(avg(precision), 9) AS precision_at_k FROM per_user", TRAIN,
        PRECISION_UNSEEN),
    "recommend_triples": sql("SELECT * FROM topk", EVENTS, TOPK_TRIPLES),
    "parse_blocks_order": sql(
        '''SELECT "user", item, CAST(row_number() OVER (PARTITION BY "user" ORDER BY item, seq) AS INT)
        AS place FROM ratings''', EVENTS),
    "vector_gram": sql(
        "SELECT CAST(a.j * 64 + b.j AS INT) AS pos, round(sum(a.v * b.v), 6) + 0.0::DOUBLE AS v "
        "FROM vectors a JOIN vectors b ON a.id = b.id GROUP BY a.j, b.j", VECTORS),
    "vector_argmax": sql(
        "SELECT id, CAST(min(j) AS INT) AS best FROM (SELECT id, j, v, max(v) OVER "
        "(PARTITION BY id) AS top FROM vectors) WHERE v = top GROUP BY id", VECTORS),
    "vector_norm": sql(
        "SELECT id, round(sum(v * v), 6) AS norm2 FROM vectors GROUP BY id", VECTORS),
}
