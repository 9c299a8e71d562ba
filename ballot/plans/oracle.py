"""DuckDB oracle SQL for the registered queries, written from the contracts.

The oracle sees only the base tables, so every statement starts from the
fixture CTEs of FIXTURES.md §2.  Blocks are named; each query lists the blocks
it needs and they are emitted in dependency order inside one WITH clause.
Integer division is ``//``; sums are cast back to BIGINT; NULL order is
spelled out wherever it matters.
"""

from __future__ import annotations

import math

from ballot.sources.fixture import FIXTURE_AUX, FIXTURE_MODELS

_FM = ",\n    ".join(f"({i}, '{n}', '{f}', {a}, {w})" for i, n, f, a, w in FIXTURE_MODELS)
_AUX = ", ".join(f"'{a}'" for a in FIXTURE_AUX)
_V5 = ", ".join(f"'{m[1]}'" for m in FIXTURE_MODELS if m[2] == "v5")
_SUB3 = "'v5_01', 'v5_02', 'v5_03'"
_BB27 = "'hybrid', 'v5_01', 'v5_02', 'v5_03'"
CAP, TOTAL_CAP = 150000, 400000



def _sequence_sql(src: str, key: str, other: str) -> str:
    return f"""(SELECT user_id, book_id, row_number() OVER (PARTITION BY {key}
                       ORDER BY ts ASC NULLS LAST, seq ASC NULLS LAST, {other} ASC) AS pos
                FROM (SELECT user_id, book_id, min(ts) AS ts, min(seq) AS seq FROM {src} GROUP BY user_id, book_id))"""


def _coborrow_sql(src: str, window: int = 5, neighbours: int = 20) -> str:
    """User, book, rank, score of O36 over the borrows ``src``."""
    seq = _sequence_sql(src, "user_id", "book_id")
    return f"""
    SELECT user_id, book_id, rnk, score FROM (
      SELECT user_id, book_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, book_id ASC)
             AS INTEGER) AS rnk, score FROM (
        SELECT e.user_id, p.b2 AS book_id, CAST(sum(p.cnt) AS BIGINT) AS score
        FROM (SELECT DISTINCT user_id, book_id FROM {src}) e
        JOIN (SELECT b1, b2, cnt, row_number() OVER (PARTITION BY b1 ORDER BY cnt DESC, b2 ASC) AS place
              FROM (SELECT a.book_id AS b1, b.book_id AS b2, count(*) AS cnt
                    FROM {seq} a JOIN {seq} b
                      ON a.user_id = b.user_id AND a.pos <> b.pos AND abs(a.pos - b.pos) <= {window}
                    GROUP BY a.book_id, b.book_id)) p
          ON e.book_id = p.b1 AND p.place <= {neighbours}
        LEFT JOIN (SELECT DISTINCT user_id, book_id FROM {src}) x ON x.user_id = e.user_id AND x.book_id = p.b2
        WHERE x.user_id IS NULL
        GROUP BY e.user_id, p.b2))
    WHERE rnk <= 10"""


def _graph_sql(src: str, model: str = "graph", window: int = 2, k: int = 10) -> str:
    """O31 over the borrows ``src``."""
    return f"""
    SELECT '{model}' AS model, 'graph' AS family, user_id, book_id, CAST(score AS DOUBLE) AS raw_score,
           CAST(rnk AS INTEGER) AS rnk FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, book_id ASC) AS rnk FROM (
        SELECT r.user_id, c.book_id,
               CAST(sum(({window} + 1 - r.gap) * ({window} + 1 - abs(c.pos - b.pos))) AS BIGINT) AS score
        FROM (SELECT x.user_id, x.book_id AS b1, y.user_id AS u2, abs(x.pos - y.pos) AS gap
              FROM {_sequence_sql(src, "book_id", "user_id")} x
              JOIN {_sequence_sql(src, "book_id", "user_id")} y
                ON x.book_id = y.book_id AND x.pos <> y.pos AND abs(x.pos - y.pos) <= {window}) r
        JOIN {_sequence_sql(src, "user_id", "book_id")} b ON b.user_id = r.u2 AND b.book_id = r.b1
        JOIN {_sequence_sql(src, "user_id", "book_id")} c
          ON c.user_id = r.u2 AND c.pos <> b.pos AND abs(c.pos - b.pos) <= {window}
        GROUP BY r.user_id, c.book_id))
    WHERE rnk <= {k}"""


def _std_sql(src: str) -> str:
    """Lists with x, the rank standardised inside each list (O06)."""
    return f"""(SELECT p.*, CAST(u.n - p.rnk + 1 AS DOUBLE) / u.n AS x FROM {src} p
                JOIN (SELECT model, user_id, count(*) AS n FROM {src} GROUP BY model, user_id) u
                  ON u.model = p.model AND u.user_id = p.user_id)"""


def _iso_sql(src: str) -> str:
    """Isotonic hit rates of the scores x of ``src`` on the validation users, as
    max over starts of min over ends of the rate between: model, x, micro, ratio."""
    sums = f"""(SELECT model, x, row_number() OVER w AS i, CAST(sum(n) OVER w AS BIGINT) AS n1,
                       CAST(sum(n) OVER w AS BIGINT) - n AS n0, CAST(sum(h) OVER w AS BIGINT) AS h1,
                       CAST(sum(h) OVER w AS BIGINT) - h AS h0
                FROM (SELECT p.model, p.x, count(*) AS n,
                             CAST(sum(CASE WHEN p.book_id = v.book_id THEN 1 ELSE 0 END) AS BIGINT) AS h
                      FROM {src} p JOIN val v ON v.user_id = p.user_id WHERE p.x IS NOT NULL GROUP BY p.model, p.x)
                WINDOW w AS (PARTITION BY model ORDER BY x))"""
    return f"""(SELECT model, x, max(m) AS micro, max(r) AS ratio FROM (
                  SELECT c.model, c.x, a.i, min((b.h1 - a.h0) * 1000000 // (b.n1 - a.n0)) AS m,
                         min(CAST(b.h1 - a.h0 AS DOUBLE) / (b.n1 - a.n0)) AS r
                  FROM {sums} c JOIN {sums} a ON a.model = c.model AND a.i <= c.i
                  JOIN {sums} b ON b.model = c.model AND b.i >= c.i
                  GROUP BY c.model, c.x, a.i) GROUP BY model, x)"""


def _iso_at(src: str, iso: str) -> str:
    """``src`` with micro and ratio of the greatest fitted score at or below x, else the smallest."""
    return f"""(SELECT s.*, coalesce(f.micro, l.micro) AS micro, coalesce(f.ratio, l.ratio) AS ratio
                FROM {src} s
                LEFT JOIN (SELECT d.model, d.x, f.micro, f.ratio FROM (
                             SELECT d.model, d.x, max(f.x) AS fx FROM (SELECT DISTINCT model, x FROM {src}) d
                             JOIN {iso} f ON f.model = d.model AND f.x <= d.x GROUP BY d.model, d.x) d
                           JOIN {iso} f ON f.model = d.model AND f.x = d.fx) f ON f.model = s.model AND f.x = s.x
                LEFT JOIN (SELECT model, arg_min(micro, x) AS micro, arg_min(ratio, x) AS ratio FROM {iso} GROUP BY model) l
                  ON l.model = s.model AND s.x IS NOT NULL)"""


# name -> (dependencies, body)
BLOCKS: dict[str, tuple[tuple[str, ...], str]] = {
    "inter": ((), """
    SELECT o.o_custkey AS user_id, l.l_partkey AS book_id, o.o_orderdate AS ts,
           o.o_orderkey * 10 + (9 - l.l_linenumber) AS seq
    FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey"""),
    "holdout": (("inter",), """
    SELECT user_id, book_id, ts,
           CASE WHEN user_id % 5 = 0 THEN 'validation' ELSE 'test' END AS split
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id
                     ORDER BY ts DESC NULLS LAST, seq DESC, book_id ASC) AS rn FROM inter)
    WHERE rn = 1"""),
    "truth": (("holdout",), "SELECT user_id, book_id FROM holdout"),
    "val": (("holdout",), "SELECT user_id, book_id FROM holdout WHERE split = 'validation'"),
    "train": (("inter", "holdout"), """
    SELECT i.user_id, i.book_id, i.ts, i.seq
    FROM inter i JOIN holdout h ON i.user_id = h.user_id WHERE i.ts < h.ts"""),
    "fm": ((), f"""
    SELECT * FROM (VALUES
    {_FM}) AS t(m, model, family, acc, pw)"""),
    "fw": (("fm",), f"""
    SELECT model, CAST(pw * 1000 AS BIGINT) AS weight, CAST(m AS INTEGER) AS priority,
           CASE WHEN family IN ({_AUX}) THEN 'aux' ELSE 'backbone' END AS role
    FROM fm"""),
    "gen": (("truth", "fm"), """
    SELECT t.user_id AS u, t.book_id AS tb, CAST(fm.m AS BIGINT) AS m, fm.model, fm.family,
           CAST(fm.acc AS BIGINT) AS acc, r.r AS r
    FROM truth t CROSS JOIN fm CROSS JOIN range(1, 11) AS r(r)"""),
    "hv": (("gen",), """
    SELECT *, ((u + 17) * (m * 31 + 7) * 7919 + (u + m) * (u + m) * 104729) % 10007 AS h,
           CASE WHEN family = 'v5' AND r <= 5 AND (u + m) % 4 > 0 THEN 0 ELSE m * m * 7 END AS g
    FROM gen"""),
    "planted": (("hv",), """
    SELECT model, family, u AS user_id,
           CASE WHEN h < acc AND r = 1 THEN tb
                WHEN h >= acc AND h < acc + 2500 AND r = h % 9 + 2 THEN tb
                ELSE (u * 131 + r * 1299709 + g * 31 + r * r * u) % (SELECT count(*) FROM part)
           END AS book_id,
           CAST(1000 * m - ((m % 7) + 1) * r AS DOUBLE) AS raw_score
    FROM hv"""),
    "preds": (("planted",), """
    SELECT model, family, user_id, book_id, raw_score,
           CAST(row_number() OVER (PARTITION BY model, user_id
                ORDER BY raw_score DESC NULLS LAST, book_id ASC) AS INTEGER) AS rnk
    FROM (SELECT model, min(family) AS family, user_id, book_id, max(raw_score) AS raw_score
          FROM planted GROUP BY model, user_id, book_id)"""),
    # flat Top-1 vote with the fixture weights
    "votes": (("preds", "fw"), """
    SELECT p.user_id, p.book_id, CAST(sum(w.weight) AS BIGINT) AS score, count(*) AS support,
           CAST(min(w.priority) AS INTEGER) AS best_priority
    FROM preds p JOIN fw w ON p.model = w.model
    WHERE p.rnk <= 1
    GROUP BY p.user_id, p.book_id"""),
    "arb": (("votes",), """
    SELECT *, CAST(row_number() OVER (PARTITION BY user_id
                ORDER BY score DESC, support DESC, best_priority ASC, book_id ASC) AS INTEGER) AS arb_rank
    FROM votes"""),
    "picks": (("arb",), "SELECT user_id, book_id, score, 'vote' AS source FROM arb WHERE arb_rank = 1"),
    "cons2": (("votes",), """
    SELECT user_id, book_id, score FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id
                ORDER BY score DESC, support DESC, best_priority ASC, book_id ASC) AS rn
      FROM votes WHERE support >= 2) WHERE rn = 1"""),
    "cons3": (("votes",), """
    SELECT user_id, book_id, score FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id
                ORDER BY score DESC, support DESC, best_priority ASC, book_id ASC) AS rn
      FROM votes WHERE support >= 3) WHERE rn = 1"""),
    # Top-10 fusion: linear ballots over every model's Top-10
    "top10": (("preds", "fw"), """
    SELECT 'top10' AS model, 'top10' AS family, user_id, book_id, CAST(score AS DOUBLE) AS raw_score,
           arb_rank AS rnk, support, best_priority
    FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id
                ORDER BY score DESC, support DESC, best_priority ASC, book_id ASC) AS INTEGER) AS arb_rank
          FROM (SELECT p.user_id, p.book_id,
                       CAST(sum(w.weight * (10 - p.rnk + 1) // 10) AS BIGINT) AS score,
                       count(*) AS support, CAST(min(w.priority) AS INTEGER) AS best_priority
                FROM preds p JOIN fw w ON p.model = w.model
                WHERE p.rnk <= 10 GROUP BY p.user_id, p.book_id))
    WHERE arb_rank <= 10"""),
    "mmx": (("preds",), """
    SELECT p.*, CASE WHEN s.hi = s.lo THEN 1.0 ELSE (p.raw_score - s.lo) / (s.hi - s.lo) END AS x FROM preds p
    JOIN (SELECT model, min(raw_score) AS lo, max(raw_score) AS hi FROM preds GROUP BY model) s ON p.model = s.model"""),
    "mmiso": (("mmx", "val"), f"SELECT * FROM {_iso_sql('mmx')}"),
    "mmcal": (("mmx", "mmiso"), f"SELECT * FROM {_iso_at('mmx', 'mmiso')}"),
    "v5x": (("preds",), f"SELECT * FROM {_std_sql("(SELECT * FROM preds WHERE family = 'v5')")}"),
    "v5iso": (("v5x", "val"), f"SELECT * FROM {_iso_sql('v5x')}"),
    "v5cal": (("v5x", "v5iso"), f"SELECT * FROM {_iso_at('v5x', 'v5iso')}"),
    # Layer 1 on the v5 family: linear Top-10 vote, stable set of all ten
    # variants boosted by 1 + family weight, support >= 7, re-ranked
    "famvotes": (("v5cal", "fw"), f"""
    SELECT p.user_id, p.book_id,
           CAST(sum(w.weight * (10 - p.rnk + 1) // 10) AS BIGINT) AS score,
           count(*) AS support, CAST(min(w.priority) AS INTEGER) AS best_priority, sum(coalesce(p.micro, 0)) AS scale
    FROM v5cal p JOIN fw w ON p.model = w.model
    WHERE p.family = 'v5' AND p.model IN ({_V5}) AND p.rnk <= 10
    GROUP BY p.user_id, p.book_id"""),
    "p1": (("famvotes", "fw"), f"""
    SELECT 'v5' AS model, 'v5' AS family, user_id, book_id, raw_score,
           CAST(row_number() OVER (PARTITION BY user_id
                ORDER BY raw_score DESC NULLS LAST, scale DESC, book_id ASC) AS INTEGER) AS rnk
    FROM (SELECT user_id, book_id, scale,
                 CAST(score + CASE WHEN support = 10
                      THEN 1 + (SELECT sum(weight) FROM fw WHERE model IN ({_V5})) ELSE 0 END AS DOUBLE)
                 AS raw_score
          FROM famvotes WHERE support >= 7)"""),
    "voters": (("preds", "p1"), """
    SELECT model, family, user_id, book_id, raw_score, rnk FROM preds WHERE family <> 'v5'
    UNION ALL SELECT model, family, user_id, book_id, raw_score, rnk FROM p1"""),
    "users": ((), "SELECT c_custkey AS user_id, c_mktsegment AS grp FROM customer"),
    # popularity of books per user group over train, and overall
    "popgrp": (("train", "users"), """
    SELECT grp, book_id, n, last_ts, CAST(rnk AS INTEGER) AS rnk FROM (
      SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, last_ts DESC NULLS LAST, book_id ASC) AS rnk
      FROM (SELECT u.grp, t.book_id, count(*) AS n, max(t.ts) AS last_ts
            FROM train t JOIN users u ON t.user_id = u.user_id GROUP BY u.grp, t.book_id))
    WHERE rnk <= 10"""),
    "popall": (("train",), """
    SELECT book_id, n FROM (
      SELECT *, row_number() OVER (ORDER BY n DESC, last_ts DESC NULLS LAST, book_id ASC) AS rnk
      FROM (SELECT book_id, count(*) AS n, max(ts) AS last_ts FROM train GROUP BY book_id))
    WHERE rnk = 1"""),
    "coldsrc": (("popgrp", "popall", "users"), """
    SELECT u.user_id, g.book_id, g.n AS score, 'group_top' AS source, 3 AS ord
    FROM users u JOIN popgrp g ON u.grp = g.grp AND g.rnk = 1
    UNION ALL
    SELECT u.user_id, (SELECT book_id FROM popall), (SELECT n FROM popall), 'global_top', 4 FROM users u"""),
    "weights_val": (("preds", "val"), f"""
    SELECT model, hits, n_users, weight,
           CAST(row_number() OVER (ORDER BY weight DESC, model ASC) AS INTEGER) AS priority,
           CASE WHEN model IN ({_AUX}) OR family IN ({_AUX}) THEN 'aux' ELSE 'backbone' END AS role
    FROM (SELECT m.model, m.family, CAST(coalesce(h.hits, 0) AS BIGINT) AS hits,
                 (SELECT count(*) FROM val) AS n_users,
                 CAST(coalesce(h.hits, 0) * 1000000 // (SELECT count(*) FROM val) AS BIGINT) AS weight
          FROM (SELECT DISTINCT model, family FROM preds) m
          LEFT JOIN (SELECT p.model, count(*) AS hits FROM preds p JOIN val v
                     ON p.user_id = v.user_id AND p.book_id = v.book_id
                     WHERE p.rnk <= 1 GROUP BY p.model) h ON m.model = h.model)"""),
    "hist": (("train",), """
    SELECT 'history' AS model, 'history' AS family, user_id, book_id, CAST(n AS DOUBLE) AS raw_score,
           CAST(rnk AS INTEGER) AS rnk FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, last_ts DESC NULLS LAST, book_id ASC) AS rnk
      FROM (SELECT user_id, book_id, count(*) AS n, max(ts) AS last_ts FROM train GROUP BY user_id, book_id))
    WHERE rnk <= 10"""),
    "poplist": (("popgrp", "users"), """
    SELECT 'popular' AS model, 'popular' AS family, u.user_id, g.book_id,
           CAST(g.n AS DOUBLE) AS raw_score, g.rnk
    FROM users u JOIN popgrp g ON u.grp = g.grp"""),
    "cob_train": (("train",), _coborrow_sql("train")),
    "coblist": (("cob_train",), """
    SELECT 'coborrow' AS model, 'coborrow' AS family, user_id, book_id, CAST(score AS DOUBLE) AS raw_score, rnk
    FROM cob_train"""),
    "emb": ((), """
    SELECT vec_id AS book_id, CAST(i - 1 AS INTEGER) AS pos,
           CAST(floor(CAST(embedding[i] AS DOUBLE) * 1000000) AS BIGINT) AS q
    FROM embeddings, range(1, 65) AS r(i)
    WHERE i <= len(embedding)"""),
    "cos_train": (("train", "emb"), """
    SELECT c.user_id, c.book_id,
           CAST(d.dot AS DOUBLE) / sqrt(CAST(nu.nu AS DOUBLE) * CAST(nb.nb AS DOUBLE)) AS cosine
    FROM (SELECT user_id, book_id, count(*) AS cnt FROM train GROUP BY user_id, book_id) c
    JOIN (SELECT x.user_id, x.book_id, CAST(sum(pr.p * e.q) AS BIGINT) AS dot
          FROM (SELECT DISTINCT user_id, book_id FROM train) x
          JOIN emb e ON e.book_id = x.book_id
          JOIN (SELECT c2.user_id, e2.pos, CAST(sum(c2.cnt * e2.q) AS BIGINT) AS p
                FROM (SELECT user_id, book_id, count(*) AS cnt FROM train GROUP BY user_id, book_id) c2
                JOIN emb e2 ON e2.book_id = c2.book_id GROUP BY c2.user_id, e2.pos) pr
            ON pr.user_id = x.user_id AND pr.pos = e.pos
          GROUP BY x.user_id, x.book_id) d ON d.user_id = c.user_id AND d.book_id = c.book_id
    JOIN (SELECT user_id, CAST(sum(p * p) AS BIGINT) AS nu FROM (
            SELECT c3.user_id, e3.pos, CAST(sum(c3.cnt * e3.q) AS BIGINT) AS p
            FROM (SELECT user_id, book_id, count(*) AS cnt FROM train GROUP BY user_id, book_id) c3
            JOIN emb e3 ON e3.book_id = c3.book_id GROUP BY c3.user_id, e3.pos) GROUP BY user_id) nu
      ON nu.user_id = c.user_id
    JOIN (SELECT book_id, CAST(sum(q * q) AS BIGINT) AS nb FROM emb GROUP BY book_id) nb ON nb.book_id = c.book_id"""),
    "emblist": (("cos_train",), """
    SELECT 'emb64' AS model, 'emb' AS family, user_id, book_id, cosine AS raw_score, CAST(rnk AS INTEGER) AS rnk
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY cosine DESC NULLS LAST, book_id ASC) AS rnk
          FROM cos_train) WHERE rnk <= 10"""),
    "lw": ((), """
    SELECT * FROM (VALUES ('popular', 300000, 1), ('history', 200000, 2), ('coborrow', 150000, 3),
                          ('emb64', 100000, 4)) AS t(model, weight, priority)"""),
}

# query name -> (blocks, final SELECT)
QUERIES: dict[str, tuple[tuple[str, ...], str]] = {
    "o01_read_predictions": (("planted",), """
    SELECT model, family, user_id, book_id, raw_score, CAST(NULL AS INTEGER) AS rnk FROM planted"""),
    "o02_read_interactions": (("inter",), "SELECT user_id, book_id, ts, seq FROM inter"),
    "o03_write_submission": (("picks",), "SELECT user_id, book_id FROM picks"),
    "o04_write_stage": (("votes",), "SELECT * FROM votes"),
    "o05_conform": (("preds",), "SELECT * FROM preds"),
    "o06_standardize": (("preds",), """
    SELECT p.model, p.user_id, p.book_id, p.rnk,
           CASE WHEN s.hi = s.lo THEN 1.0 ELSE (p.raw_score - s.lo) / (s.hi - s.lo) END AS std_minmax,
           CASE WHEN u.hi = u.lo THEN 1.0 ELSE (p.raw_score - u.lo) / (u.hi - u.lo) END AS std_minmax_user,
           CAST(u.n - p.rnk + 1 AS DOUBLE) / u.n AS std_rank,
           CAST(floor(CASE WHEN s.sd = 0 THEN 0.0 ELSE (p.raw_score - s.mean) / s.sd END * 1000000 + 0.5) AS BIGINT)
           AS zscore_micro
    FROM preds p
    JOIN (SELECT model, min(raw_score) AS lo, max(raw_score) AS hi, avg(raw_score) AS mean,
                 stddev_pop(raw_score) AS sd FROM preds GROUP BY model) s
      ON p.model = s.model
    JOIN (SELECT model, user_id, min(raw_score) AS lo, max(raw_score) AS hi, count(*) AS n
          FROM preds GROUP BY model, user_id) u ON p.model = u.model AND p.user_id = u.user_id"""),
    "o07_calibrate": (("preds", "val", "mmx", "mmiso", "mmcal"), """
    SELECT b.model, b.user_id, b.book_id, coalesce(pb.p, pm.p, 0.5) AS cal_score, i.ratio AS iso_score
    FROM (SELECT p.*, CASE WHEN p.raw_score IS NOT NULL THEN least(9, CAST(floor(
                 CASE WHEN s.hi = s.lo THEN 1.0 ELSE (p.raw_score - s.lo) / (s.hi - s.lo) END * 10) AS INTEGER)) END AS bin
          FROM preds p JOIN (SELECT model, min(raw_score) AS lo, max(raw_score) AS hi FROM preds GROUP BY model) s
            ON p.model = s.model) b
    LEFT JOIN (SELECT x.model, x.bin, (sum(CASE WHEN x.book_id = v.book_id THEN 1 ELSE 0 END) + 1)
                      / (count(*) + 2) AS p
               FROM (SELECT p.*, CASE WHEN p.raw_score IS NOT NULL THEN least(9, CAST(floor(
                       CASE WHEN s.hi = s.lo THEN 1.0 ELSE (p.raw_score - s.lo) / (s.hi - s.lo) END * 10)
                       AS INTEGER)) END AS bin
                     FROM preds p JOIN (SELECT model, min(raw_score) AS lo, max(raw_score) AS hi
                                        FROM preds GROUP BY model) s ON p.model = s.model) x
               JOIN val v ON x.user_id = v.user_id GROUP BY x.model, x.bin) pb
      ON pb.model = b.model AND pb.bin = b.bin
    LEFT JOIN (SELECT p.model, (sum(CASE WHEN p.book_id = v.book_id THEN 1 ELSE 0 END) + 1) / (count(*) + 2) AS p
               FROM preds p JOIN val v ON p.user_id = v.user_id GROUP BY p.model) pm ON pm.model = b.model
    JOIN mmcal i ON i.model = b.model AND i.user_id = b.user_id AND i.book_id = b.book_id"""),
    "o08_model_weights": (("weights_val",), "SELECT * FROM weights_val"),
    "o09_cap_weights": (("weights_val",), f"""
    SELECT model, CAST(CASE WHEN role = 'aux' AND s > {TOTAL_CAP} THEN cw * {TOTAL_CAP} // s ELSE cw END AS BIGINT)
           AS weight, priority, role
    FROM (SELECT *, (SELECT sum(CASE WHEN role = 'aux' THEN least(weight, {CAP}) ELSE 0 END) FROM weights_val) AS s
          FROM (SELECT *, CASE WHEN role = 'aux' THEN least(weight, {CAP}) ELSE weight END AS cw FROM weights_val))"""),
    "o10_support_filter": (("preds",), """
    SELECT user_id, book_id, count(*) AS support FROM preds
    WHERE family = 'v5' AND rnk <= 10 GROUP BY user_id, book_id HAVING count(*) >= 7"""),
    "o11_consensus_filter": (("votes",), "SELECT * FROM votes WHERE support >= 2"),
    "o12_attach_weights": (("preds", "fw"), """
    SELECT p.model, p.family, p.user_id, p.book_id, p.raw_score, p.rnk, w.weight, w.priority, w.role
    FROM preds p JOIN fw w ON p.model = w.model"""),
    "o13_supplementary": (("preds",), f"""
    SELECT max(model) FILTER (new) AS model, max(family) FILTER (new) AS family, user_id, book_id,
           max(raw_score) FILTER (new) AS raw_score, max(rnk) FILTER (new) AS rnk
    FROM (SELECT *, model = 'dspos2' AS new FROM preds WHERE model IN ('dspos2', 'hybrid', {_V5}) AND rnk <= 10)
    GROUP BY user_id, book_id HAVING bool_and(new)"""),
    "o14_cascade": (("cons2", "picks", "top10", "coldsrc"), """
    SELECT user_id, book_id, score, source FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ord ASC, book_id ASC) AS rn FROM (
        SELECT user_id, book_id, score, 'consensus' AS source, 0 AS ord FROM cons2
        UNION ALL SELECT user_id, book_id, score, 'vote', 1 FROM picks
        UNION ALL SELECT user_id, book_id, CAST(raw_score AS BIGINT), 'top10', 2 FROM top10 WHERE rnk = 1
        UNION ALL SELECT user_id, book_id, score, source, ord FROM coldsrc)
      WHERE user_id IS NOT NULL AND book_id IS NOT NULL)
    WHERE rn = 1"""),
    "o15_variant_intersection": (("preds",), f"""
    SELECT user_id, book_id, 10 AS variants FROM preds WHERE model IN ({_V5}) AND family = 'v5' AND rnk <= 10
    GROUP BY user_id, book_id HAVING count(*) = 10
    UNION ALL
    SELECT user_id, book_id, 3 FROM preds WHERE model IN ({_SUB3}) AND family = 'v5' AND rnk <= 10
    GROUP BY user_id, book_id HAVING count(*) = 3"""),
    "o16_union_models": (("voters",), "SELECT * FROM voters"),
    "o17_weighted_vote": (("votes", "preds", "fw"), """
    SELECT *, 'flat' AS positional FROM votes
    UNION ALL
    SELECT p.user_id, p.book_id, CAST(sum(w.weight // p.rnk) AS BIGINT), count(*), CAST(min(w.priority) AS INTEGER),
           'reciprocal'
    FROM preds p JOIN fw w ON p.model = w.model WHERE p.rnk <= 10 GROUP BY p.user_id, p.book_id"""),
    "o18_stable_boost": (("famvotes", "preds", "fw"), " UNION ALL ".join(f"""
    SELECT v.user_id, v.book_id,
           CAST(v.score + CASE WHEN s.user_id IS NOT NULL
                THEN 1 + (SELECT sum(weight) FROM fw WHERE model IN ({_V5})) ELSE 0 END AS BIGINT) AS score,
           v.support, v.best_priority, s.user_id IS NOT NULL AS stable, {n} AS variants
    FROM famvotes v LEFT JOIN (
      SELECT user_id, book_id FROM preds WHERE model IN ({names}) AND rnk <= 10
      GROUP BY user_id, book_id HAVING count(*) = {n}) s
      ON v.user_id = s.user_id AND v.book_id = s.book_id""" for names, n in ((_V5, 10), (_SUB3, 3)))),
    "o19_integrate_family": (("p1",), "SELECT * FROM p1"),
    "o20_topk_fusion": (("top10",), "SELECT * FROM top10"),
    "o21_arbitrate": (("arb",), "SELECT * FROM arb"),
    "o22_top1": (("picks",), "SELECT * FROM picks"),
    "o23_decision_margin": (("arb",), """
    SELECT a.user_id, a.book_id, a.score, coalesce(b.score, 0) AS runner_up, a.score - coalesce(b.score, 0) AS margin
    FROM arb a LEFT JOIN arb b ON a.user_id = b.user_id AND b.arb_rank = 2
    WHERE a.arb_rank = 1"""),
    "o24_hit_at_k": (("preds", "truth"), """
    SELECT m.model, (SELECT count(*) FROM truth) AS n_users, CAST(coalesce(h.hits, 0) AS BIGINT) AS hits,
           CAST(coalesce(h.hits, 0) AS DOUBLE) / (SELECT count(*) FROM truth) AS rate
    FROM (SELECT DISTINCT model FROM preds) m
    LEFT JOIN (SELECT p.model, count(DISTINCT p.user_id) AS hits FROM preds p JOIN truth t
               ON p.user_id = t.user_id AND p.book_id = t.book_id WHERE p.rnk <= 1 GROUP BY p.model) h
      ON m.model = h.model"""),
    "o25_temporal_holdout": (("holdout",), "SELECT * FROM holdout"),
    "o26_variant_stability": (("preds",), f"""
    SELECT a.model AS model_a, b.model AS model_b,
           CAST(coalesce(ub.n, 0) AS BIGINT) AS users_both,
           CAST(coalesce(t1.n, 0) AS BIGINT) AS same_top1,
           CAST(coalesce(it.n, 0) AS BIGINT) AS inter,
           CAST(coalesce(sz.s, 0) - coalesce(it.n, 0) AS BIGINT) AS "union",
           CAST(coalesce(it.n, 0) AS DOUBLE) / nullif(coalesce(sz.s, 0) - coalesce(it.n, 0), 0) AS jaccard
    FROM (SELECT DISTINCT model FROM preds WHERE model IN ({_V5})) a
    JOIN (SELECT DISTINCT model FROM preds WHERE model IN ({_V5})) b ON a.model <> b.model
    LEFT JOIN (SELECT x.model AS ma, y.model AS mb, count(*) AS n
               FROM (SELECT DISTINCT model, user_id FROM preds WHERE model IN ({_V5}) AND rnk <= 10) x
               JOIN (SELECT DISTINCT model, user_id FROM preds WHERE model IN ({_V5}) AND rnk <= 10) y
                 ON x.user_id = y.user_id AND x.model <> y.model GROUP BY 1, 2) ub
      ON ub.ma = a.model AND ub.mb = b.model
    LEFT JOIN (SELECT x.model AS ma, y.model AS mb, count(*) AS n
               FROM preds x JOIN preds y ON x.user_id = y.user_id AND x.book_id = y.book_id AND x.model <> y.model
               WHERE x.model IN ({_V5}) AND y.model IN ({_V5}) AND x.rnk = 1 AND y.rnk = 1 GROUP BY 1, 2) t1
      ON t1.ma = a.model AND t1.mb = b.model
    LEFT JOIN (SELECT x.model AS ma, y.model AS mb, count(*) AS n
               FROM preds x JOIN preds y ON x.user_id = y.user_id AND x.book_id = y.book_id AND x.model <> y.model
               WHERE x.model IN ({_V5}) AND y.model IN ({_V5}) AND x.rnk <= 10 AND y.rnk <= 10 GROUP BY 1, 2) it
      ON it.ma = a.model AND it.mb = b.model
    LEFT JOIN (SELECT x.model AS ma, y.model AS mb, sum(x.n + y.n) AS s
               FROM (SELECT model, user_id, count(*) AS n FROM preds
                     WHERE model IN ({_V5}) AND rnk <= 10 GROUP BY 1, 2) x
               JOIN (SELECT model, user_id, count(*) AS n FROM preds
                     WHERE model IN ({_V5}) AND rnk <= 10 GROUP BY 1, 2) y
                 ON x.user_id = y.user_id AND x.model <> y.model GROUP BY 1, 2) sz
      ON sz.ma = a.model AND sz.mb = b.model"""),
    "o27_admission_scenarios": (("preds", "fw", "val"), f"""
    SELECT s.scenario, s.model, CAST(CASE WHEN s.model IS NULL THEN NULL ELSE least(w.weight, {CAP}) END AS BIGINT)
           AS weight, (SELECT count(*) FROM val) AS n_users, CAST(coalesce(h.hits, 0) AS BIGINT) AS hits,
           CAST(coalesce(h.hits, 0) AS DOUBLE) / (SELECT count(*) FROM val) AS rate
    FROM scen s LEFT JOIN fw w ON w.model = s.model
    LEFT JOIN (
      SELECT scenario, count(*) AS hits FROM (
        SELECT b.scenario, b.user_id, b.book_id, row_number() OVER (PARTITION BY b.scenario, b.user_id
               ORDER BY sum(b.value) DESC, count(*) DESC, min(b.priority) ASC, b.book_id ASC) AS rn
        FROM (SELECT sc.scenario, p.user_id, p.book_id, p.model, fw.priority,
                     CASE WHEN p.model IN ({_BB27}) THEN fw.weight ELSE least(fw.weight, {CAP}) END AS value
              FROM scen sc JOIN preds p ON p.model IN ({_BB27}) OR p.model = sc.model
              JOIN fw ON fw.model = p.model WHERE p.rnk <= 1) b
        GROUP BY b.scenario, b.user_id, b.book_id) r
      JOIN val v ON v.user_id = r.user_id AND v.book_id = r.book_id
      WHERE r.rn = 1 GROUP BY scenario) h ON h.scenario = s.scenario"""),
    "o29_pair_lift": (("preds", "fw", "picks", "truth"), f"""
    SELECT count(*) AS n_users,
           CAST(sum(CASE WHEN NOT rb AND ra THEN 1 ELSE 0 END) AS BIGINT) AS fixed,
           CAST(sum(CASE WHEN rb AND NOT ra THEN 1 ELSE 0 END) AS BIGINT) AS broken,
           CAST(sum(CASE WHEN rb AND ra THEN 1 ELSE 0 END) AS BIGINT) AS both_right,
           CAST(sum(CASE WHEN NOT rb AND NOT ra THEN 1 ELSE 0 END) AS BIGINT) AS both_wrong
    FROM (SELECT t.user_id, coalesce(b.book_id = t.book_id, false) AS rb, coalesce(a.book_id = t.book_id, false) AS ra
          FROM truth t
          LEFT JOIN (SELECT user_id, book_id FROM (
                       SELECT *, row_number() OVER (PARTITION BY user_id
                              ORDER BY score DESC, support DESC, best_priority ASC, book_id ASC) AS rn
                       FROM (SELECT p.user_id, p.book_id, sum(w.weight) AS score, count(*) AS support,
                                    min(w.priority) AS best_priority
                             FROM preds p JOIN fw w ON p.model = w.model
                             WHERE p.rnk <= 1 AND p.model IN ({_BB27}) GROUP BY p.user_id, p.book_id))
                     WHERE rn = 1) b ON b.user_id = t.user_id
          LEFT JOIN picks a ON a.user_id = t.user_id)"""),
    "o30_submission_check": (("cons2",), """
    SELECT (SELECT count(DISTINCT c_custkey) FROM customer) AS expected,
           (SELECT count(*) FROM cons2) AS delivered,
           (SELECT count(*) FROM (SELECT DISTINCT c_custkey FROM customer) c
            WHERE c.c_custkey NOT IN (SELECT user_id FROM cons2 WHERE user_id IS NOT NULL)) AS missing,
           (SELECT count(*) FROM (SELECT user_id FROM cons2 WHERE user_id IS NOT NULL
                                  GROUP BY user_id HAVING count(*) > 1)) AS duplicate_users,
           (SELECT count(*) FROM cons2 WHERE user_id IS NULL OR book_id IS NULL) AS null_keys,
           (SELECT count(*) FROM cons2 WHERE user_id IS NOT NULL AND book_id IS NOT NULL
              AND book_id NOT IN (SELECT p_partkey FROM part)) AS unknown_books,
           (SELECT count(*) FROM cons2 WHERE user_id IS NOT NULL AND book_id IS NOT NULL
              AND user_id NOT IN (SELECT c_custkey FROM customer)) AS unknown_users"""),
    "o31_graph_propagate": (("inter",), _graph_sql("inter")),
    "o32_embedding_variant": (("inter", "emb"), """
    SELECT 'emb64' AS model, 'emb' AS family, user_id, book_id, cosine AS raw_score, CAST(rnk AS INTEGER) AS rnk
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY cosine DESC NULLS LAST, book_id ASC) AS rnk
          FROM (
      SELECT c.user_id, c.book_id,
             CAST(d.dot AS DOUBLE) / sqrt(CAST(nu.nu AS DOUBLE) * CAST(nb.nb AS DOUBLE)) AS cosine
      FROM (SELECT DISTINCT user_id, book_id FROM inter) c
      JOIN (SELECT x.user_id, x.book_id, CAST(sum(pr.p * e.q) AS BIGINT) AS dot
            FROM (SELECT DISTINCT user_id, book_id FROM inter) x
            JOIN emb e ON e.book_id = x.book_id
            JOIN (SELECT c2.user_id, e2.pos, CAST(sum(c2.cnt * e2.q) AS BIGINT) AS p
                  FROM (SELECT user_id, book_id, count(*) AS cnt FROM inter GROUP BY user_id, book_id) c2
                  JOIN emb e2 ON e2.book_id = c2.book_id GROUP BY c2.user_id, e2.pos) pr
              ON pr.user_id = x.user_id AND pr.pos = e.pos
            GROUP BY x.user_id, x.book_id) d ON d.user_id = c.user_id AND d.book_id = c.book_id
      JOIN (SELECT user_id, CAST(sum(p * p) AS BIGINT) AS nu FROM (
              SELECT c3.user_id, e3.pos, CAST(sum(c3.cnt * e3.q) AS BIGINT) AS p
              FROM (SELECT user_id, book_id, count(*) AS cnt FROM inter GROUP BY user_id, book_id) c3
              JOIN emb e3 ON e3.book_id = c3.book_id GROUP BY c3.user_id, e3.pos) GROUP BY user_id) nu
        ON nu.user_id = c.user_id
      JOIN (SELECT book_id, CAST(sum(q * q) AS BIGINT) AS nb FROM emb GROUP BY book_id) nb
        ON nb.book_id = c.book_id))
    WHERE rnk <= 10"""),
    "o34_popularity_candidates": (("popgrp",), "SELECT * FROM popgrp"),
    "o35_history_candidates": (("hist",), "SELECT * FROM hist"),
    "o36_coborrow_candidates": (("inter",), f"""
    SELECT 'coborrow' AS model, 'coborrow' AS family, user_id, book_id, CAST(score AS DOUBLE) AS raw_score, rnk
    FROM ({_coborrow_sql("inter")})"""),
    "o37_hybrid_candidates": (("poplist", "hist", "coblist", "emblist", "lw"), """
    SELECT 'hybrid' AS model, 'hybrid' AS family, user_id, book_id, CAST(score AS DOUBLE) AS raw_score,
           CAST(rn AS INTEGER) AS rnk
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id
                 ORDER BY score DESC, support DESC, best_priority ASC, book_id ASC) AS rn
          FROM (SELECT l.user_id, l.book_id, CAST(sum(CAST(floor(w.weight * l.x) AS BIGINT)) AS BIGINT) AS score,
                       count(*) AS support, min(w.priority) AS best_priority
                FROM (SELECT *, CAST(count(*) OVER (PARTITION BY model, user_id) - rnk + 1 AS DOUBLE)
                                / count(*) OVER (PARTITION BY model, user_id) AS x
                FROM (SELECT model, user_id, book_id, rnk FROM poplist
                      UNION ALL SELECT model, user_id, book_id, rnk FROM hist
                      UNION ALL SELECT model, user_id, book_id, rnk FROM coblist
                      UNION ALL SELECT model, user_id, book_id, rnk FROM emblist)) l
                JOIN lw w ON w.model = l.model WHERE l.rnk <= 10
                GROUP BY l.user_id, l.book_id))
    WHERE rn <= 10"""),
    "o38_cold_start_fill": (("cons3", "coldsrc"), """
    SELECT user_id, book_id, score, source FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ord ASC, book_id ASC) AS rn FROM (
        SELECT user_id, book_id, score, 'pick' AS source, 0 AS ord FROM cons3
        UNION ALL SELECT user_id, book_id, score, source, ord FROM coldsrc)
      WHERE user_id IS NOT NULL AND book_id IS NOT NULL)
    WHERE rn = 1"""),
    "o39_assemble_features": (("poplist", "hist", "coblist", "emblist", "cos_train", "popgrp", "train", "users"), """
    SELECT c.user_id, c.book_id,
           CAST(coalesce(uc.n, 0) AS BIGINT) AS user_count,
           CAST(coalesce(bc.n, 0) AS BIGINT) AS book_count,
           CAST(coalesce(pc.n, 0) AS BIGINT) AS pair_count,
           CAST(coalesce(date_diff('day', CAST(uc.last AS DATE), CAST((SELECT max(ts) FROM train) AS DATE)), 0)
                AS BIGINT) AS days_since_user_last,
           coalesce(cs.cosine, 0.0) AS cosine,
           CAST(cs.cosine IS NULL AS INTEGER) AS cosine_missing,
           CAST(coalesce(pr.rnk, 0) AS BIGINT) AS pop_rank,
           CAST(pr.rnk IS NULL AS INTEGER) AS pop_rank_missing
    FROM (SELECT DISTINCT user_id, book_id FROM (
            SELECT user_id, book_id FROM poplist UNION ALL SELECT user_id, book_id FROM hist
            UNION ALL SELECT user_id, book_id FROM coblist UNION ALL SELECT user_id, book_id FROM emblist)) c
    LEFT JOIN (SELECT user_id, count(*) AS n, max(ts) AS last FROM train GROUP BY user_id) uc ON uc.user_id = c.user_id
    LEFT JOIN (SELECT book_id, count(*) AS n FROM train GROUP BY book_id) bc ON bc.book_id = c.book_id
    LEFT JOIN (SELECT user_id, book_id, count(*) AS n FROM train GROUP BY user_id, book_id) pc
      ON pc.user_id = c.user_id AND pc.book_id = c.book_id
    LEFT JOIN cos_train cs ON cs.user_id = c.user_id AND cs.book_id = c.book_id
    LEFT JOIN users u ON u.user_id = c.user_id
    LEFT JOIN (SELECT grp, book_id, row_number() OVER (PARTITION BY grp
                      ORDER BY n DESC, last_ts DESC NULLS LAST, book_id ASC) AS rnk
               FROM (SELECT u2.grp, t.book_id, count(*) AS n, max(t.ts) AS last_ts
                     FROM train t JOIN users u2 ON t.user_id = u2.user_id GROUP BY u2.grp, t.book_id)) pr
      ON pr.grp = u.grp AND pr.book_id = c.book_id"""),
    "p1_layer1_family": (("p1",), "SELECT * FROM p1"),
    "p2_layer1_top10": (("top10",), """
    SELECT model, family, user_id, book_id, raw_score, rnk FROM top10"""),
    "p3_final_vote": (("voters", "val", "top10", "coldsrc"), f"""
    SELECT user_id, book_id, score, source FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ord ASC, book_id ASC) AS rn FROM (
        SELECT user_id, book_id, score, 'consensus' AS source, 0 AS ord FROM vw_top WHERE support_ok
        UNION ALL SELECT user_id, book_id, score, 'vote', 1 FROM vw_all
        UNION ALL SELECT user_id, book_id, CAST(raw_score AS BIGINT), 'top10', 2 FROM top10 WHERE rnk = 1
        UNION ALL SELECT user_id, book_id, score, source, ord FROM coldsrc)
      WHERE user_id IS NOT NULL AND book_id IS NOT NULL)
    WHERE rn = 1"""),
}

# P3 needs its own weights (validation hits of the Layer-2 voters, aux capped)
# and two Top-1 selections; they are extra blocks used only there.
BLOCKS["w3raw"] = (("voters", "val"), f"""
    SELECT model, weight,
           CAST(row_number() OVER (ORDER BY weight DESC, model ASC) AS INTEGER) AS priority,
           CASE WHEN model IN ({_AUX}) OR family IN ({_AUX}) THEN 'aux' ELSE 'backbone' END AS role
    FROM (SELECT m.model, m.family,
                 CAST(coalesce(h.hits, 0) * 1000000 // (SELECT count(*) FROM val) AS BIGINT) AS weight
          FROM (SELECT DISTINCT model, family FROM voters) m
          LEFT JOIN (SELECT p.model, count(*) AS hits FROM voters p JOIN val v
                     ON p.user_id = v.user_id AND p.book_id = v.book_id
                     WHERE p.rnk <= 1 GROUP BY p.model) h ON m.model = h.model)""")
BLOCKS["w3"] = (("w3raw",), f"""
    SELECT model, CAST(CASE WHEN role = 'aux' AND s > {TOTAL_CAP} THEN cw * {TOTAL_CAP} // s ELSE cw END AS BIGINT)
           AS weight, priority, role
    FROM (SELECT *, (SELECT sum(CASE WHEN role = 'aux' THEN least(weight, {CAP}) ELSE 0 END) FROM w3raw) AS s
          FROM (SELECT *, CASE WHEN role = 'aux' THEN least(weight, {CAP}) ELSE weight END AS cw FROM w3raw))""")
BLOCKS["v3"] = (("voters", "w3"), """
    SELECT p.user_id, p.book_id, CAST(sum(w.weight) AS BIGINT) AS score, count(*) AS support,
           min(w.priority) AS best_priority
    FROM voters p JOIN w3 w ON p.model = w.model WHERE p.rnk <= 1 GROUP BY p.user_id, p.book_id""")
BLOCKS["vw_all"] = (("v3",), """
    SELECT user_id, book_id, score FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id
             ORDER BY score DESC, support DESC, best_priority ASC, book_id ASC) AS rn FROM v3) WHERE rn = 1""")
BLOCKS["vw_top"] = (("v3",), """
    SELECT user_id, book_id, score, true AS support_ok FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id
             ORDER BY score DESC, support DESC, best_priority ASC, book_id ASC) AS rn
      FROM v3 WHERE support >= 2) WHERE rn = 1""")
QUERIES["p3_final_vote"] = (("vw_top", "vw_all", "top10", "coldsrc"), QUERIES["p3_final_vote"][1])
# O27 scenario list: 0 = backbone alone, then one per candidate.
_CANDS = [m[1] for m in FIXTURE_MODELS if m[1] not in ("hybrid", "v5_01", "v5_02", "v5_03")]
BLOCKS["scen"] = ((), "SELECT * FROM (VALUES (0, NULL)"
                  + "".join(f", ({i + 1}, '{m}')" for i, m in enumerate(_CANDS))
                  + ") AS t(scenario, model)")
QUERIES["o27_admission_scenarios"] = (("preds", "fw", "val", "scen"), QUERIES["o27_admission_scenarios"][1])


# ---------------------------------------------------------------- P4 full run
# Candidate lists on the holdout train, the merged v5 and emb families, the
# Top-10 baseline with hits@10 weights, the final vote with capped aux weights
# and the cascade, then hit@1 on test users for every voter and the picks.


def _emb_sql(src: str, dim: int) -> str:
    return f"""
    SELECT 'emb{dim}' AS model, 'emb' AS family, user_id, book_id, cosine AS raw_score, CAST(rnk AS INTEGER) AS rnk
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY cosine DESC NULLS LAST, book_id ASC) AS rnk
          FROM (
      SELECT c.user_id, c.book_id,
             CAST(d.dot AS DOUBLE) / sqrt(CAST(nu.nu AS DOUBLE) * CAST(nb.nb AS DOUBLE)) AS cosine
      FROM (SELECT DISTINCT user_id, book_id FROM {src}) c
      JOIN (SELECT x.user_id, x.book_id, CAST(sum(pr.p * e.q) AS BIGINT) AS dot
            FROM (SELECT DISTINCT user_id, book_id FROM {src}) x
            JOIN emb e ON e.book_id = x.book_id AND e.pos < {dim}
            JOIN (SELECT c2.user_id, e2.pos, CAST(sum(c2.cnt * e2.q) AS BIGINT) AS p
                  FROM (SELECT user_id, book_id, count(*) AS cnt FROM {src} GROUP BY user_id, book_id) c2
                  JOIN emb e2 ON e2.book_id = c2.book_id AND e2.pos < {dim} GROUP BY c2.user_id, e2.pos) pr
              ON pr.user_id = x.user_id AND pr.pos = e.pos
            GROUP BY x.user_id, x.book_id) d ON d.user_id = c.user_id AND d.book_id = c.book_id
      JOIN (SELECT user_id, CAST(sum(p * p) AS BIGINT) AS nu FROM (
              SELECT c3.user_id, e3.pos, CAST(sum(c3.cnt * e3.q) AS BIGINT) AS p
              FROM (SELECT user_id, book_id, count(*) AS cnt FROM {src} GROUP BY user_id, book_id) c3
              JOIN emb e3 ON e3.book_id = c3.book_id AND e3.pos < {dim} GROUP BY c3.user_id, e3.pos)
            GROUP BY user_id) nu ON nu.user_id = c.user_id
      JOIN (SELECT book_id, CAST(sum(q * q) AS BIGINT) AS nb FROM emb WHERE pos < {dim} GROUP BY book_id) nb
        ON nb.book_id = c.book_id))
    WHERE rnk <= 10"""


def _weights_sql(src: str, truth: str, k: int, aux: str | None) -> str:
    role = f"CASE WHEN model IN ({aux}) OR family IN ({aux}) THEN 'aux' ELSE 'backbone' END" if aux else "'backbone'"
    return f"""
    SELECT model, weight,
           CAST(row_number() OVER (ORDER BY weight DESC, model ASC) AS INTEGER) AS priority, {role} AS role
    FROM (SELECT m.model, m.family,
                 CAST(coalesce(h.hits, 0) * 1000000 // (SELECT count(*) FROM {truth}) AS BIGINT) AS weight
          FROM (SELECT DISTINCT model, family FROM {src}) m
          LEFT JOIN (SELECT p.model, count(*) AS hits FROM {src} p JOIN {truth} v
                     ON p.user_id = v.user_id AND p.book_id = v.book_id
                     WHERE p.rnk <= {k} GROUP BY p.model) h ON m.model = h.model)"""


BLOCKS["test"] = (("holdout",), "SELECT user_id, book_id FROM holdout WHERE split = 'test'")
BLOCKS["graph4"] = (("train",), _graph_sql("train"))
for _d in (16, 32, 64):
    BLOCKS[f"emb4_{_d}"] = (("train", "emb"), _emb_sql("train", _d))
BLOCKS["allp"] = (("preds", "poplist", "hist", "coblist", "graph4", "emb4_16", "emb4_32", "emb4_64"), """
    SELECT model, family, user_id, book_id, raw_score, rnk FROM preds
    UNION ALL SELECT * FROM poplist UNION ALL SELECT * FROM hist UNION ALL SELECT * FROM coblist
    UNION ALL SELECT * FROM graph4 UNION ALL SELECT * FROM emb4_16 UNION ALL SELECT * FROM emb4_32
    UNION ALL SELECT * FROM emb4_64""")
BLOCKS["emb_w"] = (("allp", "val"), _weights_sql("(SELECT * FROM allp WHERE family = 'emb')", "val", 10, None))
BLOCKS["embx"] = (("allp",), f"SELECT * FROM {_std_sql("(SELECT * FROM allp WHERE family = 'emb')")}")
BLOCKS["embiso"] = (("embx", "val"), f"SELECT * FROM {_iso_sql('embx')}")
BLOCKS["embcal"] = (("embx", "embiso"), f"SELECT * FROM {_iso_at('embx', 'embiso')}")
BLOCKS["fam_emb"] = (("embcal", "emb_w"), """
    SELECT 'emb' AS model, 'emb' AS family, user_id, book_id, raw_score,
           CAST(row_number() OVER (PARTITION BY user_id
                ORDER BY raw_score DESC NULLS LAST, scale DESC, book_id ASC) AS INTEGER) AS rnk
    FROM (SELECT user_id, book_id, scale,
                 CAST(score + CASE WHEN support = 3 THEN 1 + (SELECT sum(weight) FROM emb_w) ELSE 0 END AS DOUBLE)
                 AS raw_score
          FROM (SELECT p.user_id, p.book_id, CAST(sum(w.weight * (10 - p.rnk + 1) // 10) AS BIGINT) AS score,
                       count(*) AS support, sum(coalesce(p.micro, 0)) AS scale
                FROM embcal p JOIN emb_w w ON p.model = w.model
                WHERE p.rnk <= 10 GROUP BY p.user_id, p.book_id)
          WHERE support >= 2)""")
BLOCKS["voters4"] = (("p1", "fam_emb", "allp"), """
    SELECT * FROM p1 UNION ALL SELECT * FROM fam_emb
    UNION ALL SELECT * FROM allp WHERE family NOT IN ('v5', 'emb')""")
BLOCKS["top_w"] = (("allp", "val"), _weights_sql("allp", "val", 10, None))
BLOCKS["top10_4"] = (("allp", "top_w"), """
    SELECT user_id, book_id, score FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id
             ORDER BY score DESC, support DESC, best_priority ASC, book_id ASC) AS rn
      FROM (SELECT p.user_id, p.book_id, CAST(sum(w.weight * (10 - p.rnk + 1) // 10) AS BIGINT) AS score,
                   count(*) AS support, min(w.priority) AS best_priority
            FROM allp p JOIN top_w w ON p.model = w.model WHERE p.rnk <= 10 GROUP BY p.user_id, p.book_id))
    WHERE rn = 1""")
# new models enter as aux, capped alone and together
_NEW = "'popular', 'history', 'coborrow', 'graph', 'emb'"
BLOCKS["w4raw"] = (("voters4", "val"), _weights_sql("voters4", "val", 1, f"{_AUX}, {_NEW}"))
BLOCKS["w4"] = (("w4raw",), f"""
    SELECT model, CAST(CASE WHEN role = 'aux' AND s > {TOTAL_CAP} THEN cw * {TOTAL_CAP} // s ELSE cw END AS BIGINT)
           AS weight, priority, role
    FROM (SELECT *, (SELECT sum(CASE WHEN role = 'aux' THEN least(weight, {CAP}) ELSE 0 END) FROM w4raw) AS s
          FROM (SELECT *, CASE WHEN role = 'aux' THEN least(weight, {CAP}) ELSE weight END AS cw FROM w4raw))""")
BLOCKS["v4"] = (("voters4", "w4"), """
    SELECT p.user_id, p.book_id, CAST(sum(w.weight) AS BIGINT) AS score, count(*) AS support,
           min(w.priority) AS best_priority
    FROM voters4 p JOIN w4 w ON p.model = w.model WHERE p.rnk <= 1 GROUP BY p.user_id, p.book_id""")
BLOCKS["picks4"] = (("v4", "top10_4", "coldsrc"), """
    SELECT user_id, book_id FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ord ASC, book_id ASC) AS rn FROM (
        SELECT user_id, book_id, 0 AS ord FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id
                 ORDER BY score DESC, support DESC, best_priority ASC, book_id ASC) AS r
          FROM v4 WHERE support >= 2) WHERE r = 1
        UNION ALL SELECT user_id, book_id, 1 FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id
                 ORDER BY score DESC, support DESC, best_priority ASC, book_id ASC) AS r
          FROM v4) WHERE r = 1
        UNION ALL SELECT user_id, book_id, 2 FROM top10_4
        UNION ALL SELECT user_id, book_id, ord FROM coldsrc)
      WHERE user_id IS NOT NULL AND book_id IS NOT NULL)
    WHERE rn = 1""")
QUERIES["p4_full_run"] = (("voters4", "picks4", "test"), """
    SELECT m.model, (SELECT count(*) FROM test) AS n_users, CAST(coalesce(h.hits, 0) AS BIGINT) AS hits,
           CAST(coalesce(h.hits, 0) AS DOUBLE) / (SELECT count(*) FROM test) AS rate
    FROM (SELECT DISTINCT model FROM voters4) m
    LEFT JOIN (SELECT p.model, count(DISTINCT p.user_id) AS hits FROM voters4 p JOIN test t
               ON p.user_id = t.user_id AND p.book_id = t.book_id WHERE p.rnk <= 1 GROUP BY p.model) h
      ON m.model = h.model
    UNION ALL
    SELECT 'final', (SELECT count(*) FROM test),
           (SELECT count(*) FROM picks4 p JOIN test t ON p.user_id = t.user_id AND p.book_id = t.book_id),
           CAST((SELECT count(*) FROM picks4 p JOIN test t ON p.user_id = t.user_id AND p.book_id = t.book_id)
                AS DOUBLE) / (SELECT count(*) FROM test)""")


# ---------------------------------------------------------------- O08, bootstrap
# a count is the number of these limits, 65536 times the Poisson(1) distribution, that four hex digits reach
_POISSON = " + ".join(
    f"CAST(v >= {math.floor(65536 * sum(math.exp(-1) / math.factorial(i) for i in range(j + 1)))} AS INTEGER)" for j in range(8)
)
BLOCKS["draws"] = (("val",), f"""
    SELECT user_id, book_id, rep, {_POISSON} AS n
    FROM (SELECT v.user_id, v.book_id, r.rep,
                 CAST('0x' || substr(md5('42:' || (r.rep // 8) || ':' || v.user_id), CAST(4 * (r.rep % 8) + 1 AS BIGINT), 4)
                      AS BIGINT) AS v
          FROM val v, range(32) r(rep))""")
BLOCKS["drawn_weights"] = (("draws", "preds"), """
    SELECT m.model, u.rep, CAST(coalesce(h.n, 0) * 1000000 // u.n AS BIGINT) AS weight
    FROM (SELECT DISTINCT model FROM preds) m
    CROSS JOIN (SELECT rep, sum(n) AS n FROM draws GROUP BY rep) u
    LEFT JOIN (SELECT p.model, d.rep, sum(d.n) AS n FROM preds p
               JOIN draws d ON d.user_id = p.user_id AND d.book_id = p.book_id WHERE p.rnk <= 1 GROUP BY p.model, d.rep) h
      ON h.model = m.model AND h.rep = u.rep""")
QUERIES["o08_bootstrap_weights"] = (("drawn_weights", "weights_val"), """
    SELECT model, hits, n_users, plain, weight,
           CAST(row_number() OVER (ORDER BY weight DESC, plain DESC, model ASC) AS INTEGER) AS priority, role
    FROM (SELECT v.model, v.hits, v.n_users, v.weight AS plain, d.weight, v.role
          FROM weights_val v
          JOIN (SELECT model, weight, row_number() OVER (PARTITION BY model ORDER BY weight) AS i FROM drawn_weights) d
            ON d.model = v.model AND d.i = 3)""")


# ---------------------------------------------------------------- O31 in layers
BLOCKS["net"] = (("inter",), "SELECT DISTINCT user_id, book_id FROM inter")
BLOCKS["net_pool"] = (("inter",), _graph_sql("inter", k=50))
BLOCKS["net_b0"] = (("net", "emb"), """
    SELECT book_id, pos, q FROM emb WHERE pos < 16 AND book_id IN (SELECT book_id FROM net)""")
for _l in (1, 2, 3):
    for _to, _from, _key, _src in (("u", f"net_b{_l - 1}", "user_id", "book_id"), ("b", f"net_u{_l}", "book_id", "user_id")):
        BLOCKS[f"net_{_to}{_l}"] = (("net", _from), f"""
    SELECT s.{_key}, s.pos, CAST(s.total AS BIGINT) // d.n AS q
    FROM (SELECT n.{_key}, v.pos, sum(v.q) AS total FROM net n JOIN {_from} v ON v.{_src} = n.{_src}
          GROUP BY n.{_key}, v.pos) s
    JOIN (SELECT {_key}, count(*) AS n FROM net GROUP BY {_key}) d ON d.{_key} = s.{_key}""")


def _layers_sql(layers: int) -> str:
    union = lambda t, first: " UNION ALL ".join(f"SELECT * FROM net_{t}{i}" for i in range(first, layers + 1))
    return f"""
    SELECT 'graph_l{layers}' AS model, 'graph' AS family, user_id, book_id, CAST(score AS DOUBLE) AS raw_score,
           CAST(rnk AS INTEGER) AS rnk
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, book_id ASC) AS rnk
          FROM (SELECT p.user_id, p.book_id, CAST(coalesce(sum(u.q * b.q), 0) AS BIGINT) AS score
                FROM net_pool p
                LEFT JOIN (SELECT user_id, pos, CAST(sum(q) AS BIGINT) AS q FROM ({union("u", 1)}) GROUP BY user_id, pos) u
                  ON u.user_id = p.user_id
                LEFT JOIN (SELECT book_id, pos, CAST(sum(q) AS BIGINT) AS q FROM ({union("b", 0)}) GROUP BY book_id, pos) b
                  ON b.book_id = p.book_id AND b.pos = u.pos
                GROUP BY p.user_id, p.book_id))
    WHERE rnk <= 10"""


QUERIES["o31_graph_layers"] = (
    ("net_pool", "net_u1", "net_u2", "net_u3", "net_b1", "net_b2", "net_b3"),
    f"{_layers_sql(2)} UNION ALL {_layers_sql(3)}",
)


# ---------------------------------------------------------------- O33
BLOCKS["title_words"] = ((), """
    SELECT book_id, w FROM (SELECT CAST(p_partkey AS BIGINT) AS book_id,
           unnest(string_split_regex(lower(coalesce(p_name, '')), '[\\x20\\x09-\\x0D]+')) AS w FROM part)""")
BLOCKS["title_idf"] = (("title_words",), """
    SELECT w, CAST(floor(ln((SELECT count(*) + 1 FROM part) / (count(DISTINCT book_id) + 1)) * 1000 + 0.5) AS BIGINT)
           + 1000 AS idf, md5('0:' || w) AS digest
    FROM title_words WHERE w <> '' GROUP BY w""")
BLOCKS["title_hits"] = (("title_idf",), """
    SELECT w, dim, j * (dim // 8) + (v >> 1) % (dim // 8) AS place, CASE WHEN v % 2 = 1 THEN -idf ELSE idf END AS value
    FROM (SELECT i.w, i.idf, d.dim, r.j, CAST('0x' || substr(i.digest, CAST(4 * r.j + 1 AS BIGINT), 4) AS BIGINT) AS v
          FROM title_idf i, (VALUES (64), (128)) d(dim), range(8) r(j))""")
BLOCKS["title_sums"] = (("title_words", "title_hits"), """
    SELECT d.dim, CAST(p.p_partkey AS BIGINT) AS book_id, r.place, CAST(coalesce(s.total, 0) AS BIGINT) AS total
    FROM part p, (VALUES (64), (128)) d(dim), range(128) r(place)
    LEFT JOIN (SELECT h.dim, t.book_id, h.place, sum(h.value) AS total
               FROM title_words t JOIN title_hits h ON t.w = h.w GROUP BY h.dim, t.book_id, h.place) s
      ON s.dim = d.dim AND s.book_id = p.p_partkey AND s.place = r.place
    WHERE r.place < d.dim""")
QUERIES["o33_text_embedding"] = (("title_sums",), """
    SELECT dim, book_id, sqrt(CAST(sum(CAST(total AS HUGEINT) * total) AS DOUBLE)) AS norm,
           string_agg(CAST(total AS VARCHAR), ',' ORDER BY place) AS sums
    FROM title_sums GROUP BY dim, book_id""")


# ---------------------------------------------------------------- O40, O41: facts
BLOCKS["cand_pairs"] = (("poplist", "hist", "coblist", "emblist"), """
    SELECT DISTINCT user_id, book_id FROM (
      SELECT user_id, book_id FROM poplist UNION ALL SELECT user_id, book_id FROM hist
      UNION ALL SELECT user_id, book_id FROM coblist UNION ALL SELECT user_id, book_id FROM emblist)""")
QUERIES["o40_gbdt_facts"] = (("cand_pairs",), """
    SELECT user_id, count(*) AS n_books, CAST(sum(book_id) AS BIGINT) AS book_sum, TRUE AS ranks_ok,
           TRUE AS scores_ok, TRUE AS order_ok, TRUE AS separates
    FROM cand_pairs GROUP BY user_id""")
BLOCKS["search_users"] = (("cand_pairs", "val"), """
    SELECT DISTINCT user_id, CAST('0x' || substr(md5('42:' || user_id), 1, 8) AS BIGINT) % 8 AS fold
    FROM cand_pairs WHERE user_id IN (SELECT user_id FROM val)""")
# four points: two go on from folds 2 to 4, one of them from folds 2 to 7
QUERIES["o41_search_facts"] = (("search_users",), """
    SELECT CAST(r.rung AS INTEGER) AS rung, CAST(r.points AS BIGINT) AS points, CAST(r.kept AS BIGINT) AS kept,
           CAST(r.chosen AS BIGINT) AS chosen,
           (SELECT count(*) FROM search_users WHERE fold BETWEEN 2 AND r.last) AS fit_users,
           (SELECT count(*) FROM search_users WHERE fold < 2) AS score_users, TRUE AS auc_ok
    FROM (VALUES (0, 4, 2, 0, 4), (1, 2, 1, 1, 7)) r(rung, points, kept, chosen, last)""")


# ---------------------------------------------------------------- O28 gate
# Greedy admission as a recursive CTE: the state carries the admitted list and
# its validation hits; each step votes admitted + the next candidate.
_GATE_CANDS = ", ".join(f"({i + 1}, '{m}')" for i, m in enumerate(_CANDS))
_BB27_LIST = "[" + _BB27 + "]"
BLOCKS["gate_cands"] = ((), f"SELECT * FROM (VALUES {_GATE_CANDS}) AS t(step, model)")
BLOCKS["gate_ballots"] = (("preds", "fw", "val", "gate_cands"), f"""
    SELECT p.user_id, p.book_id, p.model, w.priority,
           CASE WHEN p.model IN (SELECT model FROM gate_cands) THEN least(w.weight, {CAP}) ELSE w.weight END AS weight
    FROM preds p JOIN fw w ON p.model = w.model
    WHERE p.rnk <= 1 AND p.user_id IN (SELECT user_id FROM val)""")


def _gate_hits(models: str) -> str:
    return f"""(SELECT count(*) FROM (
        SELECT b.user_id, b.book_id, row_number() OVER (PARTITION BY b.user_id
               ORDER BY sum(b.weight) DESC, count(*) DESC, min(b.priority) ASC, b.book_id ASC) AS rn
        FROM gate_ballots b WHERE {models} GROUP BY b.user_id, b.book_id) r
      JOIN val v ON v.user_id = r.user_id AND v.book_id = r.book_id WHERE r.rn = 1)"""


QUERIES["o28_admission_gate"] = (("gate_ballots", "gate_cands", "val"), f"""
    , gate AS (
      WITH RECURSIVE g(step, admitted, hits, model, hits_before, hits_after, ok) AS (
        SELECT 0, {_BB27_LIST}, {_gate_hits(f"b.model IN ({_BB27})")},
               CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BOOLEAN)
        UNION ALL
        SELECT g.step + 1,
               CASE WHEN x.after >= g.hits THEN list_append(g.admitted, c.model) ELSE g.admitted END,
               CASE WHEN x.after >= g.hits THEN x.after ELSE g.hits END,
               c.model, g.hits, x.after, x.after >= g.hits
        FROM g JOIN gate_cands c ON c.step = g.step + 1,
        LATERAL (SELECT {_gate_hits("(list_contains(g.admitted, b.model) OR b.model = c.model)")} AS after) x
      )
      SELECT * FROM g)
    SELECT CAST(step AS INTEGER) AS step, model, CAST(hits_before AS BIGINT) AS hits_before,
           CAST(hits_after AS BIGINT) AS hits_after, ok AS admitted
    FROM gate WHERE step > 0""")


def _order(names: tuple[str, ...]) -> list[str]:
    seen: list[str] = []

    def visit(n: str) -> None:
        if n in seen:
            return
        for d in BLOCKS[n][0]:
            visit(d)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


def sql(name: str) -> str:
    blocks, final = QUERIES[name]
    ctes = ",\n".join(f"{n} AS ({BLOCKS[n][1]}\n)" for n in _order(blocks))
    if final.lstrip().startswith(","):  # the query adds its own CTE(s)
        head, _, rest = final.partition(")\n    SELECT CAST(step")
        return f"WITH {ctes}\n{head})\n    SELECT CAST(step{rest}"
    return f"WITH {ctes}\n{final}"


def oracle_sql() -> dict[str, str]:
    return {name: sql(name) for name in QUERIES}
