"""SQL counterparts of the bindings, as named CTEs for the comparison SQL."""

from __future__ import annotations

CTES: dict[str, tuple[str, tuple[str, ...]]] = {}


def cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = (body.strip(), needs)


def with_ctes(
    query: str, *names: str, instead: dict[str, tuple[str, tuple[str, ...]]] | None = None
) -> str:
    """``query`` behind the named CTEs and everything they need, in order.

    ``instead`` gives some of them another body for this query.
    """
    known = {**CTES, **(instead or {})}
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in known[name][1]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} AS (\n{known[n][0].strip()}\n)" for n in ordered]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + query.strip()


cte(
    "frames",
    """
SELECT user_id AS video_id, event_id AS frame_id,
       epoch_us(ts) // 1000 - 1704067200000 AS timestamp_ms, event_type,
       value AS blur_score,
       CAST(json_extract_string(props, '$.k') AS DOUBLE) * 2.55::DOUBLE AS mean_brightness,
       (event_id % 97) / 97.0::DOUBLE AS dark_ratio,
       (event_id % 89) / 89.0::DOUBLE AS bright_ratio
FROM events
""",
)
cte(
    "sections",
    """
SELECT video_id, timestamp_ms // 432000000 + 1 AS section_index,
       min(timestamp_ms) AS start_ms, max(timestamp_ms) AS end_ms
FROM frames WHERE event_type = 'purchase' GROUP BY 1, 2
""",
    "frames",
)
cte(
    "windows",
    """
SELECT *,
       CASE WHEN end_ms > start_ms THEN greatest(0, start_ms - 21600000) END AS window_start_ms,
       CASE WHEN end_ms > start_ms THEN end_ms + 21600000 END AS window_end_ms
FROM sections
""",
    "sections",
)
cte(
    "in_window",
    """
SELECT f.*, w.section_index, w.start_ms, w.end_ms, w.window_start_ms, w.window_end_ms
FROM frames f JOIN windows w ON f.video_id = w.video_id
 AND (w.window_start_ms IS NULL
      OR (f.timestamp_ms >= w.window_start_ms AND f.timestamp_ms <= w.window_end_ms))
""",
    "frames",
    "windows",
)
cte(
    "gated",
    """
SELECT *, array_to_string(list_filter([
         CASE WHEN blur_score < 25 THEN 'severe_blur' END,
         CASE WHEN dark_ratio >= 0.9 OR mean_brightness <= 8 THEN 'too_dark_or_black' END,
         CASE WHEN bright_ratio >= 0.9 OR mean_brightness >= 248
              THEN 'too_bright_or_overexposed' END], lambda x: x IS NOT NULL), ', ') AS failures,
       NOT (blur_score < 25 OR dark_ratio >= 0.9 OR mean_brightness <= 8
            OR bright_ratio >= 0.9 OR mean_brightness >= 248) AS passed,
       greatest(0, least(1, greatest(0, least(1, blur_score / 200.0::DOUBLE)) * 0.6::DOUBLE
         + greatest(0, 1 - abs(mean_brightness - 128) / 128.0::DOUBLE) * 0.3::DOUBLE
         + (1 - greatest(dark_ratio, bright_ratio)) * 0.1::DOUBLE)) AS quality_score
FROM frames
""",
    "frames",
)
cte(
    "usable",
    """
SELECT i.video_id, i.section_index, i.frame_id, i.timestamp_ms, g.quality_score,
       (i.video_id * 7 + i.frame_id % 5) % (SELECT count(*) FROM embeddings) AS vec_id
FROM in_window i JOIN gated g USING (frame_id) WHERE g.passed
""",
    "in_window",
    "gated",
)
cte(
    "vec",
    """
SELECT vec_id, CAST(embedding AS DOUBLE[]) AS h FROM embeddings
""",
)
cte(
    "vec_unit",
    """
SELECT vec_id, h, list_transform(h, lambda x: x - list_sum(h) / len(h)) AS c FROM vec
""",
    "vec",
)
cte(
    "vec_hash",
    """
SELECT vec_id, CAST(CASE WHEN s >= 9223372036854775808 THEN s - 18446744073709551616::HUGEINT
                         ELSE s END AS BIGINT) AS phash
FROM (SELECT v.vec_id,
             sum(CASE WHEN v.h[u.i + 1] > list_sort(v.h[2:64])[32]
                      THEN 1::HUGEINT << CAST(u.i AS INTEGER) ELSE 0::HUGEINT END) AS s
      FROM vec v, (SELECT unnest(range(64)) AS i) u GROUP BY v.vec_id)
""",
    "vec",
)
cte(
    "vec_pairs",
    """
SELECT l.vec_id AS a, r.vec_id AS b, bit_count(xor(lh.phash, rh.phash)) AS bits,
       list_dot_product(l.c, r.c)
         / (sqrt(list_dot_product(l.c, l.c)) * sqrt(list_dot_product(r.c, r.c))) AS corr
FROM vec_unit l, vec_unit r, vec_hash lh, vec_hash rh
WHERE lh.vec_id = l.vec_id AND rh.vec_id = r.vec_id
""",
    "vec_unit",
    "vec_hash",
)
cte(
    "alike",
    """
SELECT a, b, bits, corr FROM vec_pairs WHERE corr >= 0.92 AND bits <= 6
""",
    "vec_pairs",
)
cte(
    "fold_items",
    """
SELECT u.*, s.others,
       row_number() OVER (PARTITION BY video_id, section_index
                          ORDER BY timestamp_ms, frame_id) AS n
FROM usable u JOIN (SELECT a, list(b) AS others FROM alike GROUP BY a) s ON s.a = u.vec_id
""",
    "usable",
    "alike",
)
cte(
    "fold_steps",
    """
SELECT DISTINCT video_id, section_index, 0::BIGINT AS n, NULL::BIGINT AS frame_id,
       NULL::BIGINT AS timestamp_ms, NULL::DOUBLE AS quality_score, NULL::BIGINT AS home,
       []::STRUCT(gno BIGINT, t BIGINT, q DOUBLE, vec BIGINT)[] AS live, 0::BIGINT AS made
FROM fold_items
UNION ALL
SELECT video_id, section_index, n, frame_id, timestamp_ms, quality_score,
       coalesce(hit, made + 1),
       CASE WHEN hit IS NULL
            THEN list_append(live, {'gno': made + 1, 't': timestamp_ms, 'q': quality_score,
                                    'vec': vec_id})
            ELSE list_transform(live, lambda g: CASE WHEN g.gno = hit AND quality_score > g.q
                   THEN {'gno': g.gno, 't': timestamp_ms, 'q': quality_score, 'vec': vec_id}
                   ELSE g END) END,
       made + CASE WHEN hit IS NULL THEN 1 ELSE 0 END
FROM (SELECT i.video_id, i.section_index, i.n, i.frame_id, i.timestamp_ms, i.quality_score,
             i.vec_id, s.live, s.made,
             list_max(list_transform(list_filter(s.live, lambda g:
               i.timestamp_ms - g.t <= 86400000 AND list_contains(i.others, g.vec)),
               lambda g: g.gno)) AS hit
      FROM fold_steps s JOIN fold_items i
        ON i.video_id = s.video_id AND i.section_index = s.section_index AND i.n = s.n + 1)
""",
    "fold_items",
)
cte(
    "members",
    """
SELECT video_id, section_index, frame_id, timestamp_ms, quality_score, home AS group_no,
       row_number() OVER (PARTITION BY video_id, section_index, home ORDER BY n) AS member_no,
       count(*) OVER (PARTITION BY video_id, section_index, home) AS group_size,
       first_value(frame_id) OVER (PARTITION BY video_id, section_index, home
         ORDER BY quality_score DESC, timestamp_ms, frame_id) AS representative_frame_id
FROM fold_steps WHERE n > 0
""",
    "fold_steps",
)
cte(
    "scored",
    """
SELECT video_id, section_index, frame_id, timestamp_ms,
       ((frame_id * 31 + section_index * 17) % 1000) / 1000.0::DOUBLE AS score
FROM in_window
""",
    "in_window",
)
cte(
    "candidates",
    """
SELECT video_id, section_index, frame_id AS position,
       CASE WHEN frame_id % 5 > 0 THEN frame_id END AS frame_id,
       CASE WHEN frame_id % 10 > 0 THEN 'k' || CAST(frame_id % 50 AS VARCHAR) END AS object_key,
       CASE WHEN frame_id % 3 > 0 THEN 'u' || CAST(frame_id % 20 AS VARCHAR) END AS url,
       CASE WHEN frame_id % 11 > 0
            THEN ((frame_id * 31 + section_index * 17) % 100) / 100.0::DOUBLE END AS score,
       CASE WHEN section_index % 2 = 0 THEN 1 + (frame_id * 7 + video_id) % 3
            ELSE 2 + (frame_id * 7 + video_id) % 2 END AS source_priority
FROM in_window
""",
    "in_window",
)
cte(
    "durations",
    """
SELECT c_custkey AS video_id, CAST(floor(c_acctbal * 10) AS BIGINT) AS duration_ms FROM customer
""",
)
cte(
    "catalogue",
    """
SELECT o_orderkey AS id, o_orderpriority AS title,
       'clip_' || CAST(o_orderkey AS VARCHAR) || '.mp4' AS filename,
       CASE o_orderstatus WHEN 'O' THEN 'processing' WHEN 'F' THEN 'failed'
                          WHEN 'P' THEN 'completed' END AS status,
       epoch_us(o_orderdate) // 1000 AS created_at, o_totalprice AS size_bytes, o_custkey AS owner
FROM orders
""",
)
cte(
    "even_grid",
    """
SELECT video_id, unnest(CASE WHEN duration_ms <= 0 THEN [0]
   WHEN duration_ms > 1000 AND duration_ms - 1000 - (duration_ms - 1) // 2000 * 2000 > 1000
   THEN list_append(range(0, duration_ms, 2000), duration_ms - 1000)
   ELSE range(0, duration_ms, 2000) END) AS timestamp_ms
FROM durations
""",
    "durations",
)
cte(
    "stored_frames",
    """
SELECT l_orderkey AS video_id, l_partkey AS frame_id,
       CAST(floor(l_extendedprice) AS BIGINT) AS timestamp_ms,
       'videos/' || CAST(l_orderkey AS VARCHAR) || '/frames/'
         || lpad(CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR), 9, '0') || '.jpg'
         AS object_key,
       CASE l_returnflag WHEN 'A' THEN 'selected' WHEN 'R' THEN 'rejected' END AS selection_status,
       l_discount AS selection_score, CAST(l_linenumber AS BIGINT) AS matched_section_index,
       'bucket-' || l_linestatus AS bucket
FROM lineitem
""",
)
cte(
    "calls",
    """
SELECT CAST(event_id AS VARCHAR) AS id, user_id AS video_id, event_id,
       event_type = 'signup' AS is_parent, epoch_us(ts) // 1000 AS created_at,
       CASE WHEN value > 60 THEN 'failed' ELSE 'completed' END AS status,
       NOT (event_type = 'signup' AND event_id % 2 = 0) AS has_usage,
       CASE event_id % 4 WHEN 0 THEN 'transcript' WHEN 1 THEN 'keyframes'
                         WHEN 2 THEN 'markdown' ELSE 'full' END AS mode,
       CASE WHEN event_type = 'signup' AND event_id % 2 = 0 THEN 0
            WHEN event_id % 7 = 0 THEN event_id % 11
            WHEN event_id % 5 < 4 THEN CAST(floor(value) AS BIGINT) ELSE 0 END AS prompt_tokens,
       CASE WHEN event_type = 'signup' AND event_id % 2 = 0 THEN 0
            WHEN event_id % 7 = 0 THEN 1 ELSE event_id % 5 END AS completion_tokens
FROM events WHERE event_type IN ('signup', 'purchase')
""",
)
cte(
    "ledger",
    """
SELECT *, prompt_tokens + completion_tokens AS total_tokens,
       CASE WHEN NOT is_parent OR mode = 'transcript' THEN '转写文本'
            WHEN mode = 'keyframes' THEN '筛选业务帧' ELSE '生成 Markdown' END AS feature_name,
       CASE WHEN has_usage AND event_id % 3 = 0 THEN 'm1'
            WHEN NOT is_parent THEN '本地流程'
            WHEN mode = 'transcript' THEN 'Qwen/Qwen3-ASR-1.7B + qwen3.7-plus'
            WHEN mode = 'keyframes' THEN '本地 yolov8s-world + sam2.1_b.pt'
            ELSE '本地 Markdown 生成' END AS model
FROM calls WHERE NOT is_parent OR mode <> 'full'
""",
    "calls",
)
cte(
    "linked",
    """
SELECT l.*, CASE WHEN NOT l.is_parent THEN f.id END AS parent_call_id
FROM ledger l LEFT JOIN (SELECT video_id, arg_min(id, created_at) AS id FROM ledger
                         WHERE is_parent GROUP BY 1) f ON f.video_id = l.video_id
""",
    "ledger",
)
cte(
    "rolled",
    """
SELECT p.id, p.video_id, p.feature_name, p.model, p.status, p.created_at,
       CASE WHEN p.total_tokens > 0 THEN p.prompt_tokens ELSE coalesce(c.pt, 0) END
         AS prompt_tokens,
       CASE WHEN p.total_tokens > 0 THEN p.completion_tokens ELSE coalesce(c.ct, 0) END
         AS completion_tokens,
       CASE WHEN p.total_tokens > 0 THEN p.total_tokens ELSE coalesce(c.tt, 0) END AS total_tokens
FROM linked p LEFT JOIN (
  SELECT p.id, sum(c.prompt_tokens)::BIGINT AS pt, sum(c.completion_tokens)::BIGINT AS ct,
         sum(c.total_tokens)::BIGINT AS tt
  FROM linked p JOIN linked c ON c.parent_call_id = p.id AND c.video_id = p.video_id
   AND c.feature_name = p.feature_name AND c.created_at >= p.created_at AND NOT c.is_parent
  WHERE p.is_parent GROUP BY 1) c ON c.id = p.id
WHERE p.is_parent
""",
    "linked",
)
cte(
    "doc_lines",
    """
SELECT doc_id AS video_id, unnest(range(len(lines))) AS i,
       trim(unnest(lines), ' ' || chr(9) || chr(10) || chr(13)) AS text
FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)
""",
)
cte(
    "spoken",
    """
SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY i) - 1 AS sentence_index
FROM (SELECT video_id, i, text,
        least(CASE WHEN video_id % 12 = 6 THEN 10.0 ELSE 1e12 END,
          CASE video_id % 6 WHEN 2 THEN 200 ELSE 0 END + i * 2.5)::DOUBLE AS start_seconds,
        least(CASE WHEN video_id % 12 = 6 THEN 10.0 ELSE 1e12 END,
          CASE video_id % 6 WHEN 3 THEN CASE WHEN i % 5 < 4 THEN i * 2.5 + 1.0 END
               WHEN 4 THEN i * 2.5 + 1.5 WHEN 2 THEN i * 2.5 + 202.5
               ELSE i * 2.5 + 2.5 END)::DOUBLE AS end_seconds,
        CASE WHEN video_id % 6 = 3 AND i % 5 = 4 THEN true ELSE false END AS untimed
      FROM doc_lines WHERE text <> '')
""",
    "doc_lines",
)
cte(
    "rejected",
    """
SELECT d.doc_id AS video_id,
       CASE WHEN d.doc_id % 6 = 5 THEN 'no_sentence_timestamps'
            WHEN coalesce(s.untimed, false) THEN 'missing_timestamps'
            WHEN s.video_id IS NULL THEN 'no_usable_sentences'
            WHEN s.flat THEN 'end_not_after_start' END AS reason
FROM documents d LEFT JOIN (SELECT video_id, bool_or(untimed) AS untimed,
       bool_or(end_seconds <= start_seconds) AS flat FROM spoken GROUP BY 1) s
  ON s.video_id = d.doc_id
""",
    "spoken",
)
cte(
    "sentences",
    """
SELECT conv_id AS video_id, turn AS sentence_index, turn * 10.0::DOUBLE AS start_seconds,
       turn * 10.0::DOUBLE + length(text) / 15.0::DOUBLE AS end_seconds, text
FROM conversations
""",
)
cte(
    "blocks",
    """
SELECT *, CASE WHEN video_id % 7 = 1 THEN list_filter(range(lo, hi + 1), lambda x: x <> lo + 1)
               WHEN video_id % 7 = 2 AND lo > 0 THEN range(lo - 1, hi + 1)
               WHEN video_id % 7 = 3 AND hi > lo THEN range(lo, hi)
               WHEN video_id % 7 = 6 THEN []::BIGINT[] ELSE range(lo, hi + 1) END AS idx
FROM (SELECT conv_id AS video_id, turn // 3 + 1 AS section_index, min(turn) AS lo, max(turn) AS hi,
             arg_min(role, turn) AS title
      FROM conversations GROUP BY 1, 2)
""",
)
cte(
    "used",
    "SELECT video_id, section_index, unnest(idx) AS sentence_index FROM blocks",
    "blocks",
)
cte(
    "violations",
    """
SELECT DISTINCT * FROM (
  SELECT video_id, section_index, 'no_source_indices' AS reason FROM blocks WHERE len(idx) = 0
  UNION ALL
  SELECT video_id, section_index, 'indices_not_contiguous' FROM blocks
  WHERE list_max(idx) - list_min(idx) + 1 <> len(idx)
  UNION ALL
  SELECT video_id, section_index, 'no_polished_text' FROM blocks WHERE video_id % 7 = 4
  UNION ALL
  SELECT video_id, section_index, 'no_business_frame_text' FROM blocks WHERE video_id % 7 = 5
  UNION ALL
  SELECT video_id, max(section_index), 'sentence_reused' FROM used
  GROUP BY video_id, sentence_index HAVING min(section_index) < max(section_index)
  UNION ALL
  SELECT video_id, NULL, 'sentences_not_covered' FROM sentences
  WHERE (video_id, sentence_index) NOT IN (SELECT (video_id, sentence_index) FROM used)
  UNION ALL
  SELECT video_id, NULL, 'sentences_not_covered' FROM used
  WHERE (video_id, sentence_index) NOT IN (SELECT (video_id, sentence_index) FROM sentences)
  UNION ALL
  SELECT video_id, section_index, 'timestamps_missing' FROM blocks b
  WHERE len(idx) > 0 AND NOT EXISTS (SELECT 1 FROM sentences s
    WHERE s.video_id = b.video_id AND list_contains(b.idx, s.sentence_index)))
""",
    "blocks",
    "used",
    "sentences",
)
cte(
    "graphs",
    """
SELECT p_partkey AS graph_id, p_partkey % 14 AS k, p_size % 2 + 1 AS attempt, p_size,
       regexp_replace(trim(regexp_replace(lower(p_name), '[^0-9a-z]+', ' ', 'g')), ' +', ' ', 'g')
         AS label1,
       trim(regexp_replace(lower(p_brand), '[^0-9a-z]+', ' ', 'g')) AS label2,
       lower(p_type) AS role1,
       [NULL, 'query_graph_node_incomplete', 'query_graph_node_required_not_boolean',
        'query_graph_node_weight_not_numeric', 'query_graph_node_weight_negative',
        'query_graph_node_duplicated', 'query_graph_edge_incomplete', NULL,
        'query_graph_edge_endpoint_unknown', 'query_graph_edge_required_not_boolean',
        'query_graph_missing', 'query_graph_nodes_empty', 'query_graph_edges_not_list',
        'query_graph_node_not_object'][p_partkey % 14 + 1] AS reason
FROM part
""",
)
cte(
    "det",
    """
SELECT *, sqrt(((cx - 480) / 960) * ((cx - 480) / 960) + ((cy - 270) / 540) * ((cy - 270) / 540))
         AS center_distance
FROM (SELECT *, greatest(0, least(1, (x2 - x1) * (y2 - y1) / 518400.0::DOUBLE)) AS area,
             (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy,
             x1 <= 0 OR y1 <= 0 OR x2 >= 960 OR y2 >= 540 AS border
      FROM (SELECT l_orderkey AS frame_id,
                   row_number() OVER (PARTITION BY l_orderkey
                     ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS det_no,
                   CASE WHEN p_name = 'red plate' THEN 'hand' ELSE p_name END AS label,
                   1.0::DOUBLE - l_discount * 5 AS confidence,
                   (l_suppkey % 50) * 12.0::DOUBLE AS x1, (l_partkey % 40) * 9.0::DOUBLE AS y1,
                   (l_suppkey % 50) * 12.0::DOUBLE + l_quantity * 6 AS x2,
                   (l_partkey % 40) * 9.0::DOUBLE + l_quantity * 5 AS y2
            FROM lineitem JOIN part ON p_partkey = l_partkey))
""",
)
cte(
    "ideals",
    "SELECT unnest([0.04, 0.05, 0.06, 0.08, 0.10]::DOUBLE[]) AS ideal",
)
cte(
    "det_quality",
    """
SELECT d.*, i.ideal,
       greatest(0, least(1, 0.45::DOUBLE * greatest(0, least(1, confidence))
         + 0.30::DOUBLE * greatest(0, least(1, 1 - abs(area - ideal) / ideal))
         + 0.15::DOUBLE * greatest(0, least(1, 1 - center_distance / 0.75::DOUBLE))
         + 0.10::DOUBLE * CASE WHEN border THEN 0.75::DOUBLE ELSE 1 END)) AS quality,
       greatest(0, least(1, 0.45::DOUBLE * greatest(0, least(1, confidence))
         + 0.30::DOUBLE * greatest(0, least(1, 1 - abs(area - 0.08::DOUBLE) / 0.08::DOUBLE))
         + 0.15::DOUBLE * greatest(0, least(1, 1 - center_distance / 0.75::DOUBLE))
         + 0.10::DOUBLE * CASE WHEN border THEN 0.75::DOUBLE ELSE 1 END)) AS op_quality,
       min(det_no) OVER (PARTITION BY frame_id, label) AS label_place
FROM det d, ideals i
""",
    "det",
    "ideals",
)
cte(
    "all_relations",
    """
SELECT frame_id, a AS "from", relation, b AS "to", arg_min(score, l * 1000 + r) AS score,
       min(l * 1000 + r) AS place
FROM (SELECT *, greatest(overlap, 1 - distance, 0) AS score,
             CASE WHEN a = 'hand' AND overlap >= 0.03 THEN 'occludes'
                  WHEN a = 'hand' AND distance <= 0.28 THEN 'near'
                  WHEN overlap >= 0.10 THEN 'overlaps'
                  WHEN distance <= 0.22 THEN 'near' END AS relation
      FROM (SELECT l.frame_id, l.label AS a, r.label AS b, l.det_no AS l, r.det_no AS r,
                   greatest(0, least(1, greatest(0, least(l.x2, r.x2) - greatest(l.x1, r.x1))
                     * greatest(0, least(l.y2, r.y2) - greatest(l.y1, r.y1))
                     / greatest(1, least((l.x2 - l.x1) * (l.y2 - l.y1),
                                         (r.x2 - r.x1) * (r.y2 - r.y1))))) AS overlap,
                   sqrt(((l.cx - r.cx) / 960) * ((l.cx - r.cx) / 960)
                     + ((l.cy - r.cy) / 540) * ((l.cy - r.cy) / 540)) AS distance
            FROM det l JOIN det r ON l.frame_id = r.frame_id AND l.det_no <> r.det_no))
WHERE relation IS NOT NULL GROUP BY 1, 2, 3, 4
""",
    "det",
)
cte(
    "rel",
    """
SELECT frame_id, "from", relation, "to", round(score, 4) AS score,
       row_number() OVER (PARTITION BY frame_id ORDER BY place) AS relation_no
FROM all_relations QUALIFY relation_no <= 20
""",
    "all_relations",
)
cte(
    "scene_frames",
    """
SELECT o_orderkey AS frame_id, CAST(floor(o_totalprice) AS BIGINT) % 100 AS blur_score
FROM orders WHERE o_orderkey % 20 > 0
""",
)
cte(
    "scene",
    """
SELECT f.frame_id, f.blur_score >= 25 AS sharp, coalesce(d.n, 0) AS n,
       coalesce(r.occludes, false) OR coalesce(d.hand, 0) >= 0.12 AS occluded,
       coalesce(d.total, 0) AS total, coalesce(d.largest, 0) AS largest,
       coalesce(d.dist, 1) AS dist, coalesce(d.labels, []) AS labels
FROM scene_frames f
LEFT JOIN (SELECT frame_id, count(*) AS n, sum(area) AS total, max(area) AS largest,
                  sum(area) FILTER (label = 'hand') AS hand, list(DISTINCT label) AS labels,
                  arg_max(center_distance, (area, det_no)) AS dist
           FROM det GROUP BY 1) d USING (frame_id)
LEFT JOIN (SELECT frame_id, bool_or(relation = 'occludes') AS occludes FROM rel GROUP BY 1) r
  USING (frame_id)
""",
    "scene_frames",
    "det",
    "rel",
)
cte(
    "pairs",
    """
SELECT o_custkey % 150 AS video_id, o_custkey % 5 AS section_index, o_orderkey AS frame_id,
       'Brand#' || CAST(o_custkey % 25 + 1 AS VARCHAR) AS graph_id,
       ['wiring_frame', 'operation_frame', 'completion_frame', 'alignment_frame',
        'overview_frame', 'other'][o_orderkey % 6 + 1] AS frame_type,
       ([0.08, 0.08, 0.10, 0.05, 0.04, 0.06]::DOUBLE[])[o_orderkey % 6 + 1] AS ideal,
       CAST(floor(o_totalprice) AS BIGINT) % 101 / 100.0::DOUBLE AS quality_score
FROM orders
""",
)
cte(
    "nodes",
    """
SELECT p_brand AS graph_id, n, p_name AS term,
       CASE WHEN p_name = 'red plate' THEN 'hand' ELSE p_name END AS label,
       n = 1 AS required, CASE WHEN n = 1 THEN 0.6 ELSE 0.4 END::DOUBLE AS weight
FROM (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_name) AS n
      FROM (SELECT DISTINCT p_brand, p_name FROM part)) WHERE n <= 2
""",
)
cte(
    "edges",
    """
SELECT graph_id, k % 2 = 0 AS required, ['near', 'fixed_to', 'behind'][k % 3 + 1] AS relation
FROM (SELECT graph_id, CAST(regexp_extract(graph_id, '([0-9]+)$', 1) AS BIGINT) AS k
      FROM nodes WHERE n = 2)
""",
    "nodes",
)
cte(
    "node_match",
    """
SELECT *, CASE WHEN det_no IS NULL THEN 0 ELSE greatest(0, least(1, 0.50::DOUBLE * quality
         + 0.30::DOUBLE * greatest(0, least(1, confidence)) + 0.20::DOUBLE * bonus)) END
         AS node_score
FROM (SELECT p.video_id, p.section_index, p.frame_id, n.n, n.label AS node_label, n.required,
             n.weight, q.* EXCLUDE (frame_id),
             CASE WHEN n.label = q.label THEN 1 ELSE 0.85 END::DOUBLE AS bonus
      FROM pairs p JOIN nodes n ON n.graph_id = p.graph_id
      LEFT JOIN det_quality q ON q.frame_id = p.frame_id AND q.ideal = p.ideal
       AND (q.label = n.label OR contains(q.label, n.label) OR contains(n.label, q.label)
            OR list_has_any(string_split(q.label, ' '), string_split(n.label, ' '))))
QUALIFY row_number() OVER (PARTITION BY section_index, frame_id, n ORDER BY bonus DESC, quality DESC,
  greatest(0, least(1, confidence)) DESC, border, label_place, det_no) = 1
""",
    "pairs",
    "nodes",
    "det_quality",
)
cte(
    "pair_match",
    """
SELECT p.*, a.det_no AS d1, b.det_no AS d2, a.node_label AS l1, b.node_label AS l2,
       a.label AS o1, b.label AS o2, a.required AS r1, coalesce(b.required, false) AS r2,
       a.quality AS q1, b.quality AS q2, a.border AS b1, b.border AS b2,
       a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2,
       b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2,
       (a.weight * a.node_score + coalesce(b.weight * b.node_score, 0))
         / (a.weight + coalesce(b.weight, 0)) AS node_score,
       e.relation, coalesce(e.required, false) AS edge_required, e.graph_id IS NOT NULL AS has_edge,
       coalesce(a.det_no IS NOT NULL AND b.det_no IS NOT NULL AND a.label = b.label
         AND a.x1 = b.x1 AND a.y1 = b.y1 AND a.x2 = b.x2 AND a.y2 = b.y2, false) AS same,
       greatest(0, least(1, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1))
         * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))
         / greatest(1, least((a.x2 - a.x1) * (a.y2 - a.y1), (b.x2 - b.x1) * (b.y2 - b.y1)))))
         AS overlap,
       sqrt(((a.cx - b.cx) / 960) * ((a.cx - b.cx) / 960)
         + ((a.cy - b.cy) / 540) * ((a.cy - b.cy) / 540)) AS distance,
       least(a.op_quality, b.op_quality) AS op_quality
FROM pairs p JOIN node_match a
  ON a.frame_id = p.frame_id AND a.section_index = p.section_index AND a.n = 1
LEFT JOIN node_match b
  ON b.frame_id = p.frame_id AND b.section_index = p.section_index AND b.n = 2
LEFT JOIN edges e ON e.graph_id = p.graph_id
""",
    "pairs",
    "node_match",
    "edges",
)
cte(
    "parts",
    """
SELECT m.*, s.sharp, s.occluded, s.labels, h.hx1, h.hy1, h.hx2, h.hy2, h.harea,
       greatest(0, least(1, 0.65::DOUBLE * greatest(overlap, 1 - distance, 0)
         + 0.35::DOUBLE * op_quality
         + CASE WHEN EXISTS (SELECT 1 FROM rel r WHERE r.frame_id = m.frame_id
             AND r.relation IN ('near', 'overlaps') AND ((r."from" = m.o1 AND r."to" = m.o2)
               OR (r."from" = m.o2 AND r."to" = m.o1))) THEN 0.10::DOUBLE ELSE 0 END)) AS ps,
       EXISTS (SELECT 1 FROM rel r WHERE r.frame_id = m.frame_id AND r.relation = m.relation
         AND ((r."from" = m.o1 AND r."to" = m.o2) OR (r."from" = m.o2 AND r."to" = m.o1)))
         AS explicit
FROM pair_match m JOIN scene s ON s.frame_id = m.frame_id
LEFT JOIN (SELECT frame_id, x1 AS hx1, y1 AS hy1, x2 AS hx2, y2 AS hy2, area AS harea FROM det
           WHERE label = 'hand' QUALIFY row_number() OVER (PARTITION BY frame_id
             ORDER BY area DESC, greatest(0, least(1, confidence)) DESC, border, det_no) = 1) h
  ON h.frame_id = m.frame_id
""",
    "pair_match",
    "scene",
    "rel",
    "det",
)
cte(
    "scores",
    """
SELECT *, CASE WHEN has_edge AND d1 IS NOT NULL AND d2 IS NOT NULL
       THEN greatest(0, least(1, 0.70::DOUBLE * ps + 0.30::DOUBLE *
         CASE WHEN explicit THEN 1 WHEN relation IN ('near', 'fixed_to') THEN ps ELSE 0 END))
       ELSE 0 END AS edge_score,
       CASE WHEN d1 IS NOT NULL AND d2 IS NOT NULL AND NOT same THEN ps
            WHEN d1 IS NOT NULL THEN q1 WHEN d2 IS NOT NULL THEN q2 ELSE 0 END AS spatial_score,
       CASE WHEN frame_type = 'completion_frame' AND sharp THEN 0.5 ELSE 0 END::DOUBLE
         AS signal_score,
       coalesce(d1 IS NOT NULL AND b1, false) OR coalesce(d2 IS NOT NULL AND b2, false) AS cut,
       CASE WHEN harea IS NULL THEN CASE WHEN occluded THEN 0.85::DOUBLE ELSE 1 END
            ELSE greatest(0, least(1, CASE WHEN occluded THEN least(v, 0.35::DOUBLE) ELSE v END))
       END AS visibility
FROM (SELECT *, 1 - 0.75::DOUBLE * greatest(
               CASE WHEN d1 IS NOT NULL AND o1 <> 'hand' THEN greatest(0, least(1,
                 greatest(0, least(hx2, ax2) - greatest(hx1, ax1))
                 * greatest(0, least(hy2, ay2) - greatest(hy1, ay1))
                 / greatest(1, (ax2 - ax1) * (ay2 - ay1)))) ELSE 0 END,
               CASE WHEN d2 IS NOT NULL AND o2 <> 'hand' THEN greatest(0, least(1,
                 greatest(0, least(hx2, bx2) - greatest(hx1, bx1))
                 * greatest(0, least(hy2, by2) - greatest(hy1, by1))
                 / greatest(1, (bx2 - bx1) * (by2 - by1)))) ELSE 0 END)
               - 0.25::DOUBLE * greatest(0, least(1, harea / 0.12::DOUBLE)) AS v FROM parts)
""",
    "parts",
)
cte(
    "matches",
    """
SELECT video_id, section_index, frame_id, graph_id, frame_type,
       greatest(0, least(1, 0.48::DOUBLE * node_score + 0.32::DOUBLE * edge_score
         + 0.08::DOUBLE * CASE WHEN d1 IS NOT NULL OR d2 IS NOT NULL THEN visibility ELSE 0 END
         + 0.05::DOUBLE * greatest(0, least(1, quality_score)) + 0.04::DOUBLE * signal_score
         + 0.03::DOUBLE * spatial_score - CASE WHEN sharp THEN 0 ELSE 0.10::DOUBLE END
         - CASE WHEN occluded THEN 0.08::DOUBLE + 0.10::DOUBLE * (1 - visibility) + 0.06::DOUBLE
                ELSE 0 END
         - CASE WHEN cut THEN 0.04::DOUBLE ELSE 0 END
         - CASE WHEN r1 AND d1 IS NULL THEN 0.06::DOUBLE ELSE 0 END
         - CASE WHEN r2 AND d2 IS NULL THEN 0.06::DOUBLE ELSE 0 END
         - CASE WHEN has_edge AND edge_required AND (d1 IS NULL OR d2 IS NULL)
                THEN 0.05::DOUBLE ELSE 0 END)) AS score,
       node_score, edge_score, visibility, quality_score, signal_score, spatial_score,
       array_to_string(list_filter([CASE WHEN d1 IS NOT NULL THEN l1 END,
         CASE WHEN d2 IS NOT NULL THEN l2 END,
         CASE WHEN edge_score > 0 THEN 'n1__' || relation || '__n2' END],
         lambda x: x IS NOT NULL), '|') AS matched,
       array_to_string(list_filter([CASE WHEN r1 AND d1 IS NULL THEN l1 END,
         CASE WHEN r2 AND d2 IS NULL THEN l2 END,
         CASE WHEN has_edge AND edge_required AND (d1 IS NULL OR d2 IS NULL)
              THEN 'n1__' || relation || '__n2' END], lambda x: x IS NOT NULL), '|') AS missing,
       array_to_string(list_filter([CASE WHEN NOT sharp THEN 'blur' END,
         CASE WHEN occluded THEN 'occluded' END, CASE WHEN cut THEN 'border_cut' END],
         lambda x: x IS NOT NULL), '|') AS negative_hits
FROM scores
""",
    "scores",
)
cte(
    "doc_sections",
    """
SELECT v AS video_id, s AS section_index, role AS title, text,
       format('{:02d}:{:02d}', (s - 1) * 10 // 60, (s - 1) * 10 % 60) AS start_time,
       format('{:02d}:{:02d}', ((s - 1) * 10 + 9) // 60, ((s - 1) * 10 + 9) % 60) AS end_time,
       CASE WHEN s % 2 = 0 THEN 'edited ' || role END AS polished_text,
       CASE WHEN s % 3 > 0 THEN '画面' END AS business_frame_text,
       (v + s) % 4 > 0 AS shown,
       CASE WHEN (v + s) % 4 > 0 THEN format('{:02d}:{:02d}', ((s - 1) * 10 + 1) // 60,
            ((s - 1) * 10 + 1) % 60) END AS timestamp_time,
       CASE WHEN (v + s) % 4 > 0 THEN 'videos/' || CAST(v AS VARCHAR) || '/frames/'
            || lpad(CAST(s % 3 * 1000 AS VARCHAR), 9, '0') || '/a ' || CAST(s % 2 AS VARCHAR)
            || '.PNG' END AS object_key,
       CASE WHEN (v + s) % 4 > 0 AND s % 5 > 0 THEN '/f/' || CAST(s AS VARCHAR) END AS url,
       CASE WHEN (v + s) % 4 > 0 AND s % 6 > 0 THEN ((v * 31 + s * 17) % 1000) / 1000.0::DOUBLE
            END AS score
FROM (SELECT conv_id AS v, turn + 1 AS s, role, trim(text, ' ' || chr(10)) AS text
      FROM conversations)
""",
)
cte(
    "doc_videos",
    """
SELECT conv_id AS video_id,
       CASE WHEN conv_id % 3 > 0 THEN 'A "' || role || '"' END AS video_title,
       'v' || CAST(conv_id AS VARCHAR) || '.mp4' AS filename, conv_id % 5 * 60000 AS duration_ms
FROM conversations WHERE turn = 0
""",
)
cte(
    "doc_names",
    """
SELECT video_id, object_key, position,
       CASE WHEN row_number() OVER (PARTITION BY video_id, name ORDER BY position) > 1
            THEN format('{}_{:03d}.png', name, position) ELSE name || '.png' END AS local_name
FROM (SELECT video_id, object_key, min(section_index) - 1 AS position,
             replace(regexp_extract(object_key, '([^/]+)[.]PNG$', 1), ' ', '_') AS name
      FROM doc_sections WHERE object_key IS NOT NULL GROUP BY 1, 2)
""",
    "doc_sections",
)
cte(
    "dataset_pairs",
    """
SELECT doc_id AS stem, text AS content,
       row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id)
         <= CAST(round_even(count(*) OVER () * 0.2, 0) AS BIGINT) AS is_val
FROM documents WHERE doc_id % 13 > 0 AND doc_id IN (SELECT doc_id FROM labels)
""",
)
cte(
    "classes",
    """
SELECT s_nationkey AS dataset, lower(s_name) AS name,
       row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS class_id
FROM supplier WHERE s_suppkey % 6 > 0
""",
)
