"""SQL text of the input projections, shared by the comparison queries."""

from __future__ import annotations

from ..functions import vocab


def unit(seed: str, expr: str) -> str:
    return f"(('0x' || substr(md5('{seed}:' || CAST({expr} AS VARCHAR)), 1, 15))::BIGINT / CAST(1152921504606846976 AS DOUBLE))"


def iou(a: str, b: str) -> str:
    inter = (
        f"(greatest(0, least({a}.x2,{b}.x2) - greatest({a}.x1,{b}.x1)) * "
        f"greatest(0, least({a}.y2,{b}.y2) - greatest({a}.y1,{b}.y1)))"
    )
    area = lambda t: f"(greatest(0, {t}.x2-{t}.x1) * greatest(0, {t}.y2-{t}.y1))"
    union = f"({area(a)} + {area(b)} - {inter})"
    return f"(CASE WHEN {union} > 0 THEN {inter} / {union} ELSE 0 END)"


def overlaps(a: str, b: str) -> str:
    return f"({a}.x1 < {b}.x2 AND {b}.x1 < {a}.x2 AND {a}.y1 < {b}.y2 AND {b}.y1 < {a}.y2)"


_SPLIT = lambda e: f"CASE WHEN {unit('split', e)} < 0.8 THEN 'train' WHEN {unit('split', e)} < 0.9 THEN 'val' ELSE 'test' END"


def _det(name: str, mult: int, flag: str) -> str:
    return f"""
 SELECT '{name}' AS model, frame_id, id AS det_id,
   CAST(CASE WHEN d = 10 THEN (cls + 1) % 6 ELSE cls END AS INT) AS class_id,
   CAST(gx + d AS DOUBLE) AS x1, CAST(gy + tx AS DOUBLE) AS y1,
   CAST(gx + d + w AS DOUBLE) AS x2, CAST(gy + tx + h AS DOUBLE) AS y2,
   (20 + (pk*{mult} + sk*11 + q*3 + CASE WHEN rf = 'N' THEN 0 ELSE 400 END) % 960) / CAST(1000 AS DOUBLE) AS conf
 FROM geo WHERE NOT (ls = '{flag}' AND tx = 0)"""


_CTES = {
    "dim": ((), lambda: vocab.dim_class_sql()),
    "base": ((), lambda: """
 SELECT DISTINCT l_orderkey AS frame_id, CAST(l_linenumber AS BIGINT) AS ln, l_partkey AS pk, l_suppkey AS sk,
   CAST(l_quantity AS BIGINT) AS q, CAST(round(l_discount*100) AS INT) AS d, CAST(round(l_tax*100) AS INT) AS tx,
   l_returnflag AS rf, l_linestatus AS ls FROM lineitem"""),
    "geo": (("base",), lambda: """
 SELECT *, pk*1000000 + sk*1000 + ln*100 + q AS id, (pk*7 + ln*31) % 140 AS gx, (sk*13 + q*5) % 140 AS gy,
   12 + q AS w, 12 + pk % 40 AS h, CAST(pk % 6 AS INT) AS cls FROM base"""),
    "gt": (("geo",), lambda: """
 SELECT frame_id, id AS box_id, cls AS class_id, CAST(gx AS DOUBLE) AS x1, CAST(gy AS DOUBLE) AS y1,
   CAST(gx + w AS DOUBLE) AS x2, CAST(gy + h AS DOUBLE) AS y2
 FROM geo WHERE rf <> 'N' AND frame_id % 4 <> 0"""),
    "det": (("geo",), lambda: _det("A", 37, "F")),
    "det2": (("geo",), lambda: _det("B", 41, "O")),
    "frames": ((), lambda: f"""
 SELECT o_orderkey AS frame_id, o_custkey AS coil_id,
   CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS seq,
   o_orderpriority AS camera, CASE WHEN o_orderstatus = 'F' THEN 'neu' ELSE 'sev' END AS domain,
   {_SPLIT('o_orderkey')} AS split, 200 AS width, 200 AS height,
   4 + (o_orderkey*7 % 120) / CAST(10 AS DOUBLE) AS total_ms FROM orders"""),
    "raw_runs": ((), lambda: """
 SELECT user_id AS frame_id, CAST(1 + event_id % 4 AS INT) AS class_id, CAST((event_id // 4) % 64 AS INT) AS y,
   CAST(event_id*37 % 180 AS INT) AS x_start, CAST(event_id*37 % 180 + event_id % 19 AS INT) AS x_end FROM events"""),
    "run_islands": (("raw_runs",), lambda: """
 SELECT *, sum(CASE WHEN x_start > prev + 1 OR prev IS NULL THEN 1 ELSE 0 END)
     OVER (PARTITION BY frame_id, class_id, y ORDER BY x_start, x_end ROWS UNBOUNDED PRECEDING) AS island
 FROM (SELECT *, max(x_end) OVER (PARTITION BY frame_id, class_id, y ORDER BY x_start, x_end
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM raw_runs)"""),
    "mask_runs": (("run_islands",), lambda: """
 SELECT frame_id, class_id, y, min(x_start) AS x_start, max(x_end) AS x_end
 FROM run_islands GROUP BY frame_id, class_id, y, island"""),
    "grey_hist": ((), lambda: """
 SELECT l_suppkey AS frame_id, CAST(CAST(floor(l_extendedprice) AS BIGINT) % 256 AS INT) AS level,
   CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n FROM lineitem GROUP BY ALL"""),
    "timings": ((), lambda: """
 SELECT CAST(l_linenumber % 2 AS VARCHAR) AS model, l_linestatus AS device,
   ([256,320,416,512,640])[l_suppkey % 5 + 1] AS imgsz, ([1,4,8,16])[l_partkey % 4 + 1] AS batch,
   l_orderkey AS pass_id, 2 + CAST(l_quantity AS INT) / CAST(10 AS DOUBLE) AS per_frame_ms,
   CAST(round(l_tax*100) AS INT) <> 8 AS ok FROM lineitem"""),
    "train_log": ((), lambda: """
 SELECT o_orderpriority AS run, row_number() OVER w AS epoch,
   CAST(sum(10 + o_orderkey % 7 + CASE WHEN o_orderkey % 97 = 0 THEN 60 ELSE 0 END) OVER w AS DOUBLE) AS time_s,
   (o_orderkey*13 % 1000) / CAST(1000 AS DOUBLE) AS map50, (o_orderkey*7 % 600) / CAST(1000 AS DOUBLE) AS map50_95
 FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)"""),
    "content": ((), lambda: f"""
 SELECT doc_id AS item_id, {_SPLIT('doc_id')} AS split, source AS sequence_id, sha256(text) AS content_sha256 FROM documents"""),
    "frame_events": ((), lambda: """
 SELECT ts, user_id AS line_id, event_id AS seq,
   CASE WHEN event_type = 'error' THEN 'DEFECT' ELSE 'PASS' END AS verdict, value AS total_ms FROM events"""),
    "tiles": (("frames", "det", "gt"), lambda: """
 SELECT f.frame_id AS tile_id, f.coil_id AS source_id, f.domain, f.camera, 0 AS x0, 0 AS y0, 200 AS size,
   CASE WHEN f.frame_id % 4 = 0 THEN 0 WHEN g.frame_id IS NOT NULL THEN 1 ELSE -1 END AS label,
   coalesce(b.max_conf, CAST(0 AS DOUBLE)) AS max_conf
 FROM frames f LEFT JOIN (SELECT frame_id, max(conf) AS max_conf FROM det GROUP BY 1) b USING (frame_id)
 LEFT JOIN (SELECT DISTINCT frame_id FROM gt) g USING (frame_id)"""),
    # same-class pairs at IoU 0.5, preference lists, and the greedy claim walk
    "pairs": (("det", "gt"), lambda: f"""
 SELECT d.frame_id, d.class_id, d.det_id, d.conf, g.box_id, {iou('d','g')} AS iou
 FROM det d JOIN gt g ON d.frame_id = g.frame_id AND d.class_id = g.class_id
 WHERE {iou('d','g')} >= 0.5"""),
    "wishes": (("pairs",), lambda: """
 SELECT frame_id, class_id, det_id, conf, list(box_id ORDER BY iou DESC, box_id) AS wish,
   row_number() OVER (PARTITION BY frame_id, class_id ORDER BY conf DESC, det_id) AS rn
 FROM pairs GROUP BY frame_id, class_id, det_id, conf"""),
    "walk": (("wishes",), lambda: """
 SELECT frame_id, class_id, rn, det_id, wish[1] AS box_id, [wish[1]] AS taken FROM wishes WHERE rn = 1
 UNION ALL
 SELECT n.frame_id, n.class_id, n.rn, n.det_id, n.box_id,
   CASE WHEN n.box_id IS NULL THEN n.taken ELSE list_append(n.taken, n.box_id) END
 FROM (SELECT w.frame_id, w.class_id, w.rn, w.det_id, p.taken,
         list_filter(w.wish, lambda b: NOT list_contains(p.taken, b))[1] AS box_id
       FROM walk p JOIN wishes w ON w.frame_id = p.frame_id AND w.class_id = p.class_id AND w.rn = p.rn + 1) n"""),
    "matches": (("walk",), lambda: "SELECT frame_id, class_id, det_id, box_id FROM walk WHERE box_id IS NOT NULL"),
}


def cte(*names: str) -> str:
    """WITH clause holding the named projections and everything they read."""
    done: list[str] = []

    def add(n: str) -> None:
        if n in done:
            return
        for dep in _CTES[n][0]:
            add(dep)
        done.append(n)

    for n in names:
        add(n)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({_CTES[n][1]()})" for n in done) + "\n"


def grid(values) -> str:
    """Inline relation of one DOUBLE column ``threshold``."""
    return "(SELECT unnest([" + ", ".join(repr(float(v)) for v in values) + "]::DOUBLE[]) AS threshold)"
