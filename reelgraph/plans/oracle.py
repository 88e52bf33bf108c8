"""Comparison SQL per query, for the given tables."""

from __future__ import annotations

from reelgraph.plans.oracle_base import with_ctes

SQL: dict[str, str] = {}

SQL["best_usable_frames"] = with_ctes(
    """
SELECT video_id, section_index, frame_id, timestamp_ms, round(quality_score, 6) AS score, rank
FROM (SELECT i.video_id, i.section_index, i.frame_id, i.timestamp_ms, g.quality_score,
             row_number() OVER (PARTITION BY i.video_id, i.section_index
               ORDER BY g.quality_score DESC, i.timestamp_ms, i.frame_id) AS rank
      FROM in_window i JOIN gated g USING (frame_id) WHERE g.passed)
""",
    "in_window", "gated",
)

SQL["frames_in_sections"] = with_ctes(
    "SELECT video_id, section_index, frame_id, window_start_ms, window_end_ms FROM in_window",
    "in_window",
)
SQL["frames_in_sections_strict"] = with_ctes(
    """
SELECT f.video_id, s.section_index, f.frame_id FROM frames f JOIN sections s
  ON f.video_id = s.video_id AND f.timestamp_ms BETWEEN s.start_ms AND s.end_ms
""",
    "sections",
)
SQL["relevant_frames"] = with_ctes(
    "SELECT DISTINCT video_id, frame_id, timestamp_ms FROM in_window", "in_window"
)
SQL["quality_gate"] = with_ctes(
    """
SELECT video_id, frame_id, failures, passed, round(quality_score, 6) AS quality_score,
       CASE WHEN passed THEN 'Passed local quality checks.'
            ELSE 'Rejected by local quality filter: ' || failures || '.' END AS quality_reason
FROM gated
""",
    "gated",
)
SQL["duplicate_pairs"] = with_ctes(
    """
SELECT l.video_id, l.section_index, l.frame_id AS left_frame_id, r.frame_id AS right_frame_id,
       CAST(a.bits AS BIGINT) AS hash_distance, round(a.corr, 6) AS correlation
FROM usable l JOIN usable r
  ON l.video_id = r.video_id AND l.section_index = r.section_index
 AND (l.timestamp_ms < r.timestamp_ms
      OR (l.timestamp_ms = r.timestamp_ms AND l.frame_id < r.frame_id))
 AND r.timestamp_ms - l.timestamp_ms <= 86400000
JOIN alike a ON a.a = l.vec_id AND a.b = r.vec_id
""",
    "usable", "alike",
)
SQL["near_duplicate_groups"] = with_ctes(
    """
SELECT video_id, section_index, frame_id, group_no, member_no, group_size,
       representative_frame_id, frame_id = representative_frame_id AS is_representative
FROM members
""",
    "members",
)
SQL["dedup_frame_report"] = with_ctes(
    """
SELECT video_id, section_index, frame_id,
       CASE WHEN frame_id = representative_frame_id THEN 'kept' ELSE 'duplicate_rejected' END
         AS dedup_status,
       format('section_{}_query_graph_dedup_group_{:04d}', section_index, group_no)
         AS dedup_group_id,
       CASE WHEN frame_id <> representative_frame_id THEN representative_frame_id END
         AS duplicate_of_frame_id,
       round(quality_score, 6) AS quality_score
FROM members
""",
    "members",
)
SQL["dedup_group_report"] = with_ctes(
    """
SELECT video_id, section_index,
       format('section_{}_query_graph_dedup_group_{:04d}', section_index, group_no)
         AS dedup_group_id,
       any_value(representative_frame_id) AS representative_frame_id,
       any_value(group_size) AS group_size, 0::BIGINT AS part_no,
       string_agg(CAST(frame_id AS VARCHAR), ',' ORDER BY member_no) AS frame_ids
FROM members GROUP BY video_id, section_index, group_no
""",
    "members",
)
SQL["rank_frames"] = with_ctes(
    """
SELECT video_id, section_index, frame_id, score,
       row_number() OVER (PARTITION BY video_id, section_index
                          ORDER BY score DESC, timestamp_ms, frame_id) AS rank
FROM scored
""",
    "scored",
)
SQL["best_section_per_frame"] = with_ctes(
    """
SELECT video_id, frame_id, section_index, score
FROM scored QUALIFY row_number() OVER (PARTITION BY video_id, frame_id
                                       ORDER BY score DESC, section_index) = 1
""",
    "scored",
)
SQL["best_frame_per_section"] = with_ctes(
    """
SELECT video_id, section_index, position, frame_id, object_key, url, score, source_priority
FROM candidates QUALIFY row_number() OVER (PARTITION BY video_id, section_index
  ORDER BY source_priority, score DESC NULLS LAST, position) = 1
""",
    "candidates",
)
SQL["distinct_keep_first"] = with_ctes(
    """
SELECT video_id, section_index, identity, position, frame_id, object_key, url
FROM (SELECT *, coalesce(CAST(frame_id AS VARCHAR), object_key, url) AS identity FROM candidates)
WHERE identity IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY video_id, section_index, identity ORDER BY position) = 1
""",
    "candidates",
)
SQL["top_n_display"] = with_ctes(
    """
SELECT video_id, section_index, frame_id, score, rank, frames_total
FROM (SELECT *, count(*) OVER (PARTITION BY video_id, section_index) AS frames_total,
             row_number() OVER (PARTITION BY video_id, section_index
                                ORDER BY score DESC, timestamp_ms, frame_id) AS rank
      FROM scored) WHERE rank <= 5
""",
    "scored",
)
SQL["top_matches"] = with_ctes(
    """
SELECT *, row_number() OVER (PARTITION BY video_id, section_index
                             ORDER BY score DESC, first_position) AS rank
FROM (SELECT video_id, section_index, coalesce(CAST(frame_id AS VARCHAR), object_key, url)
               AS identity, max(coalesce(score, 0)) AS score, min(position) AS first_position
      FROM candidates GROUP BY 1, 2, 3)
WHERE identity IS NOT NULL QUALIFY rank <= 5
""",
    "candidates",
)
SQL["find_frame"] = with_ctes(
    """
SELECT t.video_id, t.section_index, min(c.position) AS found_position
FROM (SELECT * FROM candidates QUALIFY row_number() OVER (PARTITION BY video_id, section_index
        ORDER BY position DESC) = 1) t
JOIN candidates c ON c.video_id = t.video_id AND c.section_index = t.section_index
 AND (c.frame_id = t.frame_id OR c.object_key = t.object_key OR c.url = t.url)
GROUP BY 1, 2
""",
    "candidates",
)
SQL["resolve_selection"] = with_ctes(
    """
SELECT f.video_id, f.frame_id,
       CASE WHEN m.candidate THEN 'selected' ELSE 'rejected' END AS selection_status,
       CASE WHEN m.candidate THEN 'graph_index_matching'
            WHEN r.frame_id IS NULL THEN 'section_window'
            WHEN NOT g.passed THEN 'quality_filter'
            WHEN m.dups > 0 THEN 'section_dedup' ELSE 'section_window' END AS selection_stage,
       CASE WHEN m.candidate THEN 'Semantic frame candidate scored by graph index matching.'
            WHEN r.frame_id IS NULL THEN 'Frame is outside all transcript section windows.'
            WHEN NOT g.passed THEN 'Rejected by local quality filter: ' || g.failures || '.'
            WHEN m.dups > 0 THEN 'Rejected as a duplicate frame in transcript section windows.'
            ELSE 'Frame is outside all transcript section windows.' END AS selection_reason,
       CASE WHEN m.candidate THEN b.score ELSE 0.0 END AS selection_score,
       CASE WHEN m.candidate THEN b.section_index END AS matched_section_index,
       CASE WHEN m.candidate OR r.frame_id IS NULL OR NOT g.passed THEN 0
            ELSE coalesce(m.dups, 0) END AS duplicate_sections,
       CASE WHEN NOT m.candidate THEN m.first_dup END AS first_duplicate_section
FROM frames f JOIN gated g USING (frame_id)
LEFT JOIN (SELECT DISTINCT frame_id FROM in_window) r USING (frame_id)
LEFT JOIN (SELECT frame_id, bool_or(frame_id = representative_frame_id) AS candidate,
                  count(*) FILTER (frame_id <> representative_frame_id) AS dups,
                  min(section_index) FILTER (frame_id <> representative_frame_id) AS first_dup
           FROM members GROUP BY 1) m USING (frame_id)
LEFT JOIN (SELECT s.frame_id, s.section_index, s.score FROM scored s
           JOIN members k ON k.frame_id = s.frame_id AND k.section_index = s.section_index
            AND k.frame_id = k.representative_frame_id
           QUALIFY row_number() OVER (PARTITION BY s.frame_id
                                      ORDER BY s.score DESC, s.section_index) = 1) b
  USING (frame_id)
""",
    "gated", "in_window", "members", "scored",
)
SQL["dense_grid"] = with_ctes("SELECT * FROM even_grid", "even_grid")
SQL["timeline_grid"] = with_ctes(
    """
SELECT video_id, unnest(CASE WHEN last - p[-1] > step // 2
                             THEN CASE WHEN len(p) < 3 THEN list_append(p, last)
                                       ELSE list_append(p[1:2], last) END
                             ELSE p END) AS timestamp_ms
FROM (SELECT *, greatest(0, duration_ms - 1000) AS last, range(0, duration_ms, step)[1:3] AS p
      FROM (SELECT *, greatest(30000, (duration_ms + 2) // 3) AS step FROM durations
            WHERE duration_ms > 0))
UNION ALL SELECT video_id, 0 FROM durations WHERE duration_ms <= 0
""",
    "durations",
)
SQL["scene_changes"] = """
SELECT l_orderkey AS video_id,
       CAST(round_even(l_extendedprice / 100 * 1000, 0) AS BIGINT) AS timestamp_ms
FROM lineitem WHERE l_discount * 4 > 0.25
"""
SCENE_POINTS = """
SELECT DISTINCT o_custkey AS video_id, greatest(0, (o_orderkey * 37) % 110000 - 500) AS timestamp_ms
FROM orders
"""


def _spaced(points: str, spacing: int, tail: str = "") -> str:
    """Minimum spacing as a jump to the next far enough time of the video."""
    body = with_ctes("", "even_grid").rstrip()
    return f"""{body},
points AS ({points}),
kept AS (
  SELECT video_id, min(timestamp_ms) AS timestamp_ms FROM points GROUP BY 1
  UNION ALL
  SELECT video_id, nxt FROM (
    SELECT k.video_id, (SELECT min(p.timestamp_ms) FROM points p
       WHERE p.video_id = k.video_id AND p.timestamp_ms >= k.timestamp_ms + {spacing}) AS nxt
    FROM kept k) WHERE nxt IS NOT NULL)
SELECT video_id, timestamp_ms FROM kept {tail}
"""


SQL["min_spacing_filter"] = _spaced(SCENE_POINTS, 5000)
SQL["candidate_timestamps"] = _spaced(
    """
SELECT video_id, timestamp_ms FROM even_grid
UNION
SELECT o_custkey, (o_orderkey * 37) % 110000 - 500 FROM orders JOIN durations
  ON o_custkey = video_id
WHERE (o_orderkey * 37) % 110000 >= 500
  AND (duration_ms <= 0 OR (o_orderkey * 37) % 110000 - 500 < duration_ms)
""",
    500,
)
SQL["spacing_with_cap"] = _spaced(
    SCENE_POINTS,
    5001,
    "QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY timestamp_ms) <= 4",
)
SQL["bucket_top_k"] = """
SELECT video_id, timestamp_ms FROM (
  SELECT video_id, timestamp_ms FROM (
    SELECT DISTINCT o_custkey AS video_id, CAST(floor(o_totalprice) AS BIGINT) AS timestamp_ms
    FROM orders WHERE o_custkey % 4 = 0 OR floor(o_totalprice) < o_custkey % 4 * 120000)
  QUALIFY row_number() OVER (PARTITION BY video_id, timestamp_ms // 60000
                             ORDER BY timestamp_ms) <= 2)
QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY timestamp_ms) <= 5
"""

SQL["segments_overlapping"] = with_ctes(
    """
SELECT s.video_id, w.sentence_index AS section_index, s.sentence_index
FROM sentences s JOIN sentences w ON s.video_id = w.video_id
 AND s.end_seconds >= w.start_seconds - 5 AND s.start_seconds <= w.end_seconds + 12
""",
    "sentences",
)
SQL["catalogue_filter"] = with_ctes(
    """
SELECT id, title, filename, status FROM catalogue
WHERE (contains(lower(title), 'p_1') OR contains(lower(filename), 'p_1')) AND status = 'completed'
""",
    "catalogue",
)
SQL["page_info"] = """
SELECT count(*) AS total, greatest(1, (count(*) + 19) // 20) AS total_pages,
       least(1000000, greatest(1, (count(*) + 19) // 20)) AS page FROM orders
"""
SQL["catalogue_page"] = with_ctes(
    """
SELECT * FROM catalogue WHERE contains(lower(title), 'low') OR contains(lower(filename), 'low')
ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 40
""",
    "catalogue",
)
SQL["catalogue_page_deep"] = with_ctes(
    """
SELECT * EXCLUDE (n, total) FROM (
  SELECT *, row_number() OVER (ORDER BY created_at, id) AS n, count(*) OVER () AS total
  FROM catalogue WHERE status = 'failed')
WHERE n > (total - 1) // 7 * 7
""",
    "catalogue",
)
SQL["recent"] = with_ctes(
    "SELECT * FROM catalogue ORDER BY created_at DESC, id DESC LIMIT 30", "catalogue"
)
SQL["public_job_view"] = with_ctes(
    """
SELECT *, CASE WHEN status = 'failed' THEN '视频解析失败'
               WHEN id % 2 = 0 THEN 'trace ' || title ELSE '' END AS error_message,
       CASE status WHEN 'processing' THEN '处理中' WHEN 'failed' THEN '失败' ELSE '已完成' END
         AS status_label
FROM catalogue
""",
    "catalogue",
)
SQL["frame_view"] = with_ctes(
    """
SELECT video_id, frame_id, timestamp_ms, round(timestamp_ms / 1000.0::DOUBLE, 3) AS timestamp_seconds,
       format('{:02d}:{:02d}', CAST(round_even(timestamp_ms / 1000.0::DOUBLE, 0) AS BIGINT) // 60,
              CAST(round_even(timestamp_ms / 1000.0::DOUBLE, 0) AS BIGINT) % 60) AS timestamp_time,
       object_key, '/api/videos/' || CAST(video_id AS VARCHAR) || '/frames/'
         || string_split(object_key, '/')[-1] AS url,
       coalesce(selection_status, 'pending') AS selection_status, selection_score,
       matched_section_index
FROM stored_frames
""",
    "stored_frames",
)
SQL["latest_state"] = """
SELECT id, status, updated_at, seq FROM (
  SELECT user_id AS id, event_type AS status, epoch_us(ts) // 86400000000 AS updated_at,
         event_id AS seq
  FROM events WHERE event_id % 50 > 0
    AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 9 = 0))
QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC,
  CASE WHEN status IN ('purchase', 'error') THEN 1 ELSE 0 END DESC, seq DESC) = 1
"""
SQL["apply_job_updates"] = """
SELECT c_custkey AS id,
       coalesce(arg_max(event_type, event_id) FILTER (event_type <> 'view'),
                lower(any_value(c_mktsegment))) AS status,
       greatest(0, least(100, coalesce(arg_max(CAST(floor(value * 3 - 20) AS BIGINT), event_id)
         FILTER (event_type IN ('view', 'click')), 10))) AS progress_percent,
       greatest(0, coalesce(arg_max(CAST(floor(value) AS BIGINT) - 30, event_id)
         FILTER (event_type = 'click'), 0)) AS stage_processed,
       coalesce(arg_max(left(repeat('signup ', 60), 255), event_id)
         FILTER (event_type = 'signup'), 'waiting') AS stage_message,
       coalesce(max(epoch_us(ts) // 1000), 1704067200000) AS updated_at
FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY c_custkey
"""
SQL["unknown_updates"] = """
SELECT user_id AS id, event_id AS seq, CASE WHEN event_type <> 'view' THEN event_type END AS status,
       'unknown_id' AS reason
FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 > 0)
"""
SQL["job_permissions"] = with_ctes(
    """
SELECT id, status IN ('uploaded', 'completed', 'completed_with_warnings', 'failed', 'deleting') AS deletable,
       status NOT IN ('deleting', 'queued', 'processing') AS parseable
FROM catalogue
""",
    "catalogue",
)
SQL["fail_interrupted"] = with_ctes(
    """
SELECT * REPLACE (CASE WHEN status = 'processing' THEN 'failed' ELSE status END AS status),
       CASE WHEN status = 'processing' THEN 'failed' END AS current_stage,
       CASE WHEN status = 'processing' THEN 100 END::BIGINT AS progress_percent,
       CASE WHEN status = 'processing'
            THEN 'Background job was interrupted by service restart.' END AS error_message,
       CASE WHEN status = 'processing' THEN 1704067200000 END AS completed_at,
       CASE WHEN status = 'processing' THEN 1704067200000 END AS updated_at
FROM catalogue
""",
    "catalogue",
)
SQL["purge_videos"] = with_ctes(
    """
SELECT c.id, c.status, (SELECT count(*) FROM lineitem WHERE l_orderkey = c.id) AS frames
FROM catalogue c WHERE c.status = 'processing'
  OR c.id NOT IN (SELECT c_custkey * 12 FROM customer WHERE c_custkey % 10 <> 0)
""",
    "catalogue",
)
SQL["purge_refusals"] = with_ctes(
    """
SELECT r.id, CASE WHEN r.id LIKE '../%' THEN 'invalid_id' WHEN c.id IS NULL THEN 'not_found'
                  ELSE 'active' END AS reason
FROM (SELECT CASE WHEN c_custkey % 10 = 0 THEN '../' || CAST(c_custkey AS VARCHAR)
                  ELSE CAST(c_custkey * 12 AS VARCHAR) END AS id FROM customer) r
LEFT JOIN catalogue c ON CAST(c.id AS VARCHAR) = r.id
WHERE c.id IS NULL OR c.status = 'processing'
""",
    "catalogue",
)
SQL["buckets_to_clean"] = with_ctes(
    """
SELECT id AS video_id, 'main' AS bucket FROM catalogue
UNION SELECT id, 'src-' || title FROM catalogue
UNION SELECT f.video_id, f.bucket FROM stored_frames f JOIN catalogue c ON c.id = f.video_id
""",
    "catalogue", "stored_frames",
)
SQL["usage_tokens"] = with_ctes(
    """
SELECT id, prompt_tokens, completion_tokens, prompt_tokens + completion_tokens AS total_tokens
FROM calls
""",
    "calls",
)
SQL["classify_calls"] = with_ctes(
    """
SELECT l.id, l.feature_name, l.model, k.parent_call_id
FROM ledger l JOIN linked k ON k.id = l.id
""",
    "linked",
)
SQL["usage_rollup"] = with_ctes(
    """
SELECT id, video_id, feature_name, prompt_tokens, completion_tokens, total_tokens FROM rolled
""",
    "rolled",
)
SQL["usage_summary"] = with_ctes(
    """
SELECT id, video_id, feature_name, model, total_tokens, status,
       CASE status WHEN 'failed' THEN '失败' ELSE '已完成' END AS status_label FROM rolled
""",
    "rolled",
)
SQL["usage_total"] = with_ctes(
    """
SELECT count(*) AS calls, coalesce(sum(total_tokens), 0)::BIGINT AS total_tokens FROM rolled
WHERE contains(lower(model), 'sam2') AND status = 'completed'
""",
    "rolled",
)
SQL["extract_sentences"] = with_ctes(
    """
SELECT s.video_id, s.sentence_index, s.start_seconds, s.end_seconds, s.text
FROM spoken s JOIN rejected r USING (video_id) WHERE r.reason IS NULL
""",
    "rejected", "spoken",
)
SQL["rejected_responses"] = with_ctes("SELECT * FROM rejected WHERE reason IS NOT NULL", "rejected")
SQL["asr_text"] = with_ctes(
    """
SELECT d.doc_id AS video_id, md5(coalesce(t, '')) AS text_md5, length(coalesce(t, '')) AS chars
FROM documents d LEFT JOIN (SELECT video_id, string_agg(text, '' ORDER BY i) AS t FROM doc_lines
  WHERE video_id % 6 < 5 GROUP BY 1) s ON s.video_id = d.doc_id
""",
    "doc_lines",
)
SQL["model_json"] = """
SELECT doc_id AS video_id,
       CASE WHEN doc_id % 5 < 3 THEN 'ok' WHEN doc_id % 5 = 3 THEN 'malformed_json'
            ELSE 'not_an_object' END AS outcome,
       CASE WHEN doc_id % 5 < 3 THEN lang END AS title,
       CASE WHEN doc_id % 5 < 3 THEN length(text) END AS chars
FROM documents
"""
SQL["validate_sections"] = with_ctes("SELECT * FROM violations", "violations")
SQL["valid_section_ranges"] = with_ctes(
    """
SELECT u.video_id, u.section_index, round(min(s.start_seconds), 6) AS start_seconds,
       round(max(s.end_seconds), 6) AS end_seconds
FROM used u JOIN sentences s USING (video_id, sentence_index)
WHERE u.video_id NOT IN (SELECT video_id FROM violations) GROUP BY 1, 2
""",
    "violations",
)
SQL["section_texts"] = with_ctes(
    r"""
SELECT u.video_id, u.section_index, 0::BIGINT AS part_no,
       string_agg(trim(regexp_replace(s.text, '\s+', ' ', 'g')), ' ' ORDER BY sentence_index)
         AS text
FROM used u JOIN sentences s USING (video_id, sentence_index) GROUP BY 1, 2
""",
    "used", "sentences",
)
SQL["repair_section_ranges"] = """
WITH RECURSIVE s AS (
  SELECT conv_id AS video_id, turn AS section_index, turn * 7.0::DOUBLE AS a,
         turn * 7.0::DOUBLE + length(text) % 40 - 5 AS z,
         CASE WHEN conv_id % 3 = 0 THEN 1e12::DOUBLE ELSE conv_id % 3 * 30.0::DOUBLE END AS lim,
         conv_id % 3 * 30.0::DOUBLE AS duration_seconds,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
f AS (
  SELECT *, greatest(0, least(lim, a)) AS start_seconds,
         greatest(0, least(lim, greatest(a, z))) AS end_seconds FROM s WHERE n = 1
  UNION ALL
  SELECT s.*, greatest(0, least(s.lim, greatest(s.a, f.end_seconds))),
         greatest(0, least(s.lim, greatest(s.a, s.z, f.end_seconds)))
  FROM f JOIN s ON s.video_id = f.video_id AND s.n = f.n + 1)
SELECT video_id, section_index, duration_seconds, start_seconds, end_seconds,
       format('{:02d}:{:02d}', CAST(start_seconds AS BIGINT) // 60, CAST(start_seconds AS BIGINT) % 60)
         AS start_time,
       format('{:02d}:{:02d}', CAST(end_seconds AS BIGINT) // 60, CAST(end_seconds AS BIGINT) % 60)
         AS end_time
FROM f
"""
SQL["model_context"] = with_ctes(
    r"""
SELECT video_id, md5(c) AS context_md5, length(c) AS chars, whole_chars
FROM (SELECT video_id, length(t) AS whole_chars,
             CASE WHEN length(t) > 2000
                  THEN regexp_replace(left(t, 2000), '\s+$', '') || chr(10) || chr(10)
                       || '[内容过长，已截断。]' ELSE t END AS c
      FROM (SELECT s.video_id, string_agg(format('[{}] {:02d}:{:02d}-{:02d}:{:02d} {}',
              s.sentence_index, CAST(round_even(s.start_seconds, 0) AS BIGINT) // 60,
              CAST(round_even(s.start_seconds, 0) AS BIGINT) % 60,
              CAST(round_even(s.end_seconds, 0) AS BIGINT) // 60,
              CAST(round_even(s.end_seconds, 0) AS BIGINT) % 60, s.text), chr(10)
              ORDER BY s.sentence_index) AS t
            FROM spoken s JOIN rejected r USING (video_id) WHERE r.reason IS NULL GROUP BY 1))
""",
    "rejected", "spoken",
)
SQL["validate_query_graph"] = with_ctes(
    """
SELECT graph_id, reason, CASE WHEN reason IS NULL THEN label1 || '|' || label2 END AS terms
FROM graphs
""",
    "graphs",
)
SQL["graph_nodes"] = with_ctes(
    """
SELECT graph_id, 0::BIGINT AS node_no, 'a' AS id, label1 AS label, role1 AS role,
       true AS required, 0.5::DOUBLE AS weight FROM graphs WHERE reason IS NULL
UNION ALL
SELECT graph_id, 1, 'b_part', label2, 'part', false, p_size FROM graphs WHERE reason IS NULL
""",
    "graphs",
)
SQL["graph_edges"] = with_ctes(
    """
SELECT graph_id, 0::BIGINT AS edge_no, 'a' AS "from", 'next_to' AS relation, 'b_part' AS "to",
       false AS required, 1.0::DOUBLE AS weight FROM graphs WHERE reason IS NULL
""",
    "graphs",
)
SQL["retry_set"] = with_ctes(
    """
SELECT graph_id, attempt + 1 AS attempt, reason, 'validation error: ' || reason AS feedback
FROM graphs WHERE reason IS NOT NULL AND attempt < 2
""",
    "graphs",
)
SQL["query_spec"] = r"""
WITH d AS (
  SELECT doc_id, lang, source, text,
         ['接线完成', '安装工具', '测试结果', '孔位对齐', '展示组件', '其他'][doc_id % 6 + 1] AS title,
         CASE WHEN doc_id % 4 > 0 THEN '画面 ' || lang ELSE '' END AS business
  FROM documents),
w AS (
  SELECT doc_id, unnest(range(len(words))) AS i, unnest(words) AS word
  FROM (SELECT doc_id, string_split(trim(regexp_replace(
          business || ' ' || text || ' ' || title || ' ' || title,
          '[\s\x{00a0}\x{2000}-\x{200a}\x{3000},，。.!?；;:：、/\\()（）\[\]【】"''“”‘’]+', ' ', 'g')), ' ') AS words FROM d)),
k AS (
  SELECT doc_id, i, CASE WHEN word IN ('s', 'S') THEN 'signal' WHEN word = '+' THEN 'positive terminal'
                         WHEN word = '-' THEN 'negative terminal'
                         WHEN length(word) > 2 THEN lower(word) END AS term FROM w),
t AS (SELECT doc_id, string_agg(term, '|' ORDER BY i) AS terms, count(*) AS n
      FROM (SELECT doc_id, term, min(i) AS i FROM k WHERE term IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
SELECT d.doc_id AS video_id,
       CASE doc_id % 6 WHEN 0 THEN 'wiring_frame' WHEN 1 THEN 'operation_frame'
            WHEN 2 THEN 'completion_frame' WHEN 3 THEN 'alignment_frame' ELSE 'overview_frame' END
         AS frame_type,
       CASE WHEN business <> '' THEN business ELSE title END AS target,
       lang || ' part|' || source AS graph_terms, md5(coalesce(t.terms, '')) AS query_terms_md5,
       coalesce(t.n, 0) AS query_terms,
       CASE doc_id % 6 WHEN 0 THEN 'clear_key_region|detail_rich' WHEN 1 THEN 'clear_key_region|detail_rich'
            WHEN 2 THEN 'clear_key_region|sharp' WHEN 3 THEN 'clear_key_region|close_up'
            ELSE 'close_up|detail_rich' END AS expected_signals
FROM d LEFT JOIN t USING (doc_id)
"""
SQL["label_forms"] = """
SELECT p_partkey, lower(p_name) || ' ' || lower(p_type) AS label,
       CASE WHEN p_name = 'red plate' THEN 'hand' ELSE p_name END AS synonym,
       replace(lower(p_name), ' ', '_') || '_' || lower(p_type) AS graph_id,
       p_type || '.png' AS file_name
FROM part
"""
SQL["time_forms"] = """
SELECT o_orderkey, round(s, 6) AS seconds,
       CASE WHEN t IS NULL THEN NULL WHEN t >= 3600 THEN format('{:02d}:{:02d}:{:02d}', t // 3600, t % 3600 // 60, t % 60)
            ELSE format('{:02d}:{:02d}', t // 60, t % 60) END AS clock,
       CASE WHEN u IS NULL THEN NULL WHEN u <= 0 THEN '未知'
            WHEN u >= 3600 THEN format('{:02d}:{:02d}:{:02d}', u // 3600, u % 3600 // 60, u % 60)
            ELSE format('{:02d}:{:02d}', u // 60, u % 60) END AS duration,
       CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE 0 END AS frame_ms
FROM (SELECT *, CAST(round_even(floor(s) + 0.5::DOUBLE, 0) AS BIGINT) AS t,
             CAST(floor(s) AS BIGINT) - 5 AS u
      FROM (SELECT *, CASE o_orderkey % 4
                WHEN 0 THEN CASE WHEN o_orderkey % 8 = 0 AND o_totalprice > 100000
                                 THEN o_totalprice / 1000 ELSE o_totalprice END
                WHEN 1 THEN (o_orderkey % 3 * 3600 + o_custkey % 60 * 60 + o_orderkey % 50)::DOUBLE
                WHEN 3 THEN (o_orderkey % 100)::DOUBLE END AS s FROM orders))
"""
SQL["clipped_texts"] = r"""
SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS collapsed_md5,
       md5(CASE WHEN length(text) > 500 THEN regexp_replace(left(text, 500), '\s+$', '')
             || chr(10) || chr(10) || '[内容过长，已截断。]' ELSE text END) AS clipped_md5,
       CASE WHEN length(text) > 100 THEN length(regexp_replace(left(text, 100), '\s+$', '')) + 3
            ELSE length(text) END AS summary_chars,
       md5(replace(replace(text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"')) AS escaped_md5
FROM documents
"""
SQL["object_inventory"] = """
SELECT url AS object_key, 'application/octet-stream' AS media_type,
       octet_length(encode(html)) AS size_bytes, sha256(html) AS checksum FROM pages
"""

SQL["normalize_detections"] = with_ctes(
    """
SELECT frame_id, det_no, label, round(confidence, 6) AS confidence, x1, y1, x2, y2,
       x1 AS mx1, y1 AS my1, x2 AS mx2, y2 AS my2, round(area, 6) AS bbox_area_ratio,
       round(area, 6) AS area, round(cx, 6) AS centroid_x, round(cy, 6) AS centroid_y,
       border AS touches_border
FROM det
""",
    "det",
)
SQL["mask_metrics"] = with_ctes(
    """
, m AS (SELECT *, det_no % 3 > 0 AS has_mask,
               CAST(floor((x2 - x1) / 60) AS BIGINT) AS k,
               floor(x1 / 30) AS px, floor(y1 / 30) AS py FROM det)
SELECT frame_id, det_no, label,
       CASE WHEN NOT has_mask THEN x1 WHEN k = 0 THEN 0 ELSE px * 30 END AS mx1,
       CASE WHEN NOT has_mask THEN y1 WHEN k = 0 THEN 0 ELSE py * 30 END AS my1,
       CASE WHEN NOT has_mask THEN x2 WHEN k = 0 THEN 0 ELSE (px + k) * 30 END AS mx2,
       CASE WHEN NOT has_mask THEN y2 WHEN k = 0 THEN 0 ELSE (py + least(k, 3)) * 30 END AS my2,
       round(CASE WHEN NOT has_mask OR k = 0 THEN area ELSE k / 576.0::DOUBLE END, 6) AS area,
       round(CASE WHEN NOT has_mask THEN cx WHEN k = 0 THEN 480
                  ELSE (px + (k - 1) / 2.0::DOUBLE) * 30 END, 6) AS centroid_x,
       round(CASE WHEN NOT has_mask THEN cy WHEN k = 0 THEN 270
                  ELSE (py + list_sum(list_transform(range(k), lambda i: i % 3)) / k::DOUBLE) * 30
             END, 6) AS centroid_y,
       CASE WHEN NOT has_mask THEN border WHEN k = 0 THEN false
            ELSE px <= 0 OR py <= 0 OR (px + k) * 30 >= 960 OR (py + least(k, 3)) * 30 >= 540 END
         AS touches_border
FROM m
""",
    "det",
).replace("\n, m AS", ",\nm AS")
SQL["object_quality"] = with_ctes(
    """
SELECT frame_id, det_no, round(any_value(center_distance), 9) AS center_distance,
       round(any_value(quality) FILTER (ideal = 0.08), 9) AS quality_operation_frame,
       round(any_value(quality) FILTER (ideal = 0.05), 9) AS quality_alignment_frame,
       round(any_value(quality) FILTER (ideal = 0.06), 9) AS quality_other
FROM det_quality GROUP BY 1, 2
""",
    "det_quality",
)
SQL["scene_relations"] = with_ctes("SELECT * FROM rel", "rel")
SQL["frame_signals"] = with_ctes(
    """
SELECT frame_id, array_to_string(list_sort(list_filter(list_concat([
         CASE WHEN sharp THEN 'sharp' END, CASE WHEN sharp THEN 'not_blurry' END,
         CASE WHEN occluded THEN 'occluded' END,
         CASE WHEN n >= 2 OR total >= 0.08 THEN 'detail_rich' END,
         CASE WHEN largest >= 0.10 THEN 'close_up' END,
         CASE WHEN largest >= 0.03 AND dist <= 0.42 AND NOT occluded THEN 'clear_key_region' END,
         CASE WHEN sharp AND NOT occluded THEN 'stable_frame' END,
         CASE WHEN largest >= 0.08 THEN 'main_subject_large' END,
         CASE WHEN (largest > 0 AND largest < 0.02) OR total < 0.01 THEN 'tiny_subject' END],
         list_transform(labels, lambda x: 'has_' || replace(x, ' ', '_'))),
         lambda x: x IS NOT NULL)), '|') AS signals,
       11 + len(list_filter(labels, lambda x: x <> 'hand')) AS known
FROM scene
""",
    "scene",
)
SQL["match_nodes"] = with_ctes(
    """
SELECT video_id, section_index, frame_id, n - 1 AS node_no, node_label, label AS object_label,
       det_no, round(node_score, 6) AS node_score FROM node_match
""",
    "node_match",
)
SQL["match_score"] = with_ctes(
    """
SELECT video_id, section_index, frame_id, graph_id, frame_type, round(score, 9) AS score,
       round(node_score, 9) AS node_score, round(edge_score, 9) AS edge_score,
       round(visibility, 9) AS visibility, round(quality_score, 9) AS quality_score,
       signal_score, round(spatial_score, 9) AS spatial_score, matched, missing, negative_hits
FROM matches
""",
    "matches",
)
SQL["default_match"] = with_ctes(
    """
SELECT p.video_id, p.section_index, p.frame_id, p.graph_id, p.frame_type, 0.0::DOUBLE AS score,
       '' AS matched, string_agg(n.term, '|' ORDER BY n.n) AS missing, '' AS negative_hits
FROM pairs p JOIN nodes n ON n.graph_id = p.graph_id WHERE p.frame_id % 20 = 0
GROUP BY ALL
""",
    "pairs", "nodes",
)

SQL["slim_frames"] = with_ctes(
    """
SELECT video_id, section_index, count(*) AS frames, count(nullif(frame_id, 0)) AS with_id,
       count(*) FILTER (position % 2 = 1) AS default_captions
FROM candidates WHERE coalesce(frame_id, 0) <> 0 OR object_key IS NOT NULL OR url IS NOT NULL
GROUP BY 1, 2
""",
    "candidates",
)
SQL["attach_report"] = with_ctes(
    """
SELECT s.*, c.frame_id AS business_frame_id FROM sections s LEFT JOIN (
  SELECT * FROM candidates QUALIFY row_number() OVER (PARTITION BY video_id, section_index
    ORDER BY position DESC) = 1) c USING (video_id, section_index)
""",
    "sections", "candidates",
)
SQL["run_summary"] = with_ctes(
    """
SELECT video_id, raw_frame_count, coalesce(c, 0) AS candidate_frame_count,
       coalesce(sc, 0) AS section_candidate_frame_count, coalesce(s, 0) AS section_count,
       coalesce(g, 0) AS query_graph_count
FROM (SELECT video_id, count(*) AS raw_frame_count FROM frames GROUP BY 1)
LEFT JOIN (SELECT video_id, count(DISTINCT frame_id) AS c, count(*) AS sc FROM members
           WHERE frame_id = representative_frame_id GROUP BY 1) USING (video_id)
LEFT JOIN (SELECT video_id, count(*) AS s, count(*) FILTER (section_index % 2 = 0) AS g
           FROM sections GROUP BY 1) USING (video_id)
""",
    "frames", "members", "sections",
)
SQL["render_transcript"] = with_ctes(
    """
SELECT s.video_id, 0::BIGINT AS part_no,
       '# ' || any_value(coalesce(v.video_title, '视频转写')) || chr(10) || chr(10)
       || string_agg(concat('## ', s.section_index, '. ', s.title, chr(10), chr(10),
            '**时间范围：** ', s.start_time, ' - ', s.end_time, chr(10), chr(10), '### 正文',
            chr(10), chr(10), s.text, chr(10), chr(10), '### 润色后正文', chr(10), chr(10),
            coalesce(s.polished_text, '未识别。'), chr(10), chr(10), '### 待匹配文本',
            chr(10), chr(10), coalesce(s.business_frame_text, '未识别。')),
            chr(10) || chr(10) || chr(10) ORDER BY s.section_index) || chr(10) AS document
FROM doc_sections s LEFT JOIN doc_videos v USING (video_id) GROUP BY 1
""",
    "doc_sections", "doc_videos",
)
SQL["render_markdown"] = with_ctes(
    """
SELECT s.video_id, 0::BIGINT AS part_no,
       any_value(concat('---', chr(10), 'document_role: "video_analysis_result"', chr(10),
         'video_id: "', s.video_id, '"', chr(10), 'video_title: "',
         replace(coalesce(v.video_title, '视频分析结果'), '"', chr(92) || '"'), '"', chr(10),
         'source_filename: "', v.filename, '"', chr(10), 'duration: "',
         CASE WHEN v.duration_ms = 0 THEN '未知' ELSE format('{:02d}:00', v.duration_ms // 60000) END,
         '"', chr(10), '---', chr(10), chr(10), '# ', coalesce(v.video_title, '视频分析结果'),
         chr(10), chr(10)))
       || string_agg(concat('## ', s.section_index, '. ', s.title, chr(10), chr(10),
            '**时间范围：** ', s.start_time, ' - ', s.end_time, chr(10), chr(10),
            '### 润色后正文', chr(10), chr(10), coalesce(s.polished_text, s.text), chr(10), chr(10),
            '### 业务帧', chr(10), chr(10),
            CASE WHEN NOT s.shown THEN '- 无' ELSE concat('- **', s.timestamp_time, '** ',
              CASE WHEN s.url IS NULL THEN '业务帧' ELSE concat('[业务帧](', s.url, ')') END,
              CASE WHEN s.score IS NOT NULL
                   THEN concat(chr(10), '  - 相似度分数：', format('{:.4f}', s.score)) END) END),
            chr(10) || chr(10) ORDER BY s.section_index) || chr(10) AS document
FROM doc_sections s LEFT JOIN doc_videos v USING (video_id) GROUP BY 1
""",
    "doc_sections", "doc_videos",
)
SQL["unique_names"] = with_ctes("SELECT * FROM doc_names", "doc_names")
SQL["manifest"] = with_ctes(
    """
SELECT s.video_id, v.filename, s.section_index, s.title, s.start_time, s.timestamp_time AS timestamp,
       s.score, CASE WHEN s.object_key IN (SELECT object_key FROM doc_sections
                  WHERE section_index % 2 = 0 AND object_key IS NOT NULL)
                THEN 'frames/' || n.local_name END AS path
FROM doc_sections s LEFT JOIN doc_videos v USING (video_id)
LEFT JOIN doc_names n ON n.video_id = s.video_id AND n.object_key = s.object_key
""",
    "doc_sections", "doc_videos", "doc_names",
)
SQL["output_lineage"] = """
SELECT doc_id AS video_id,
       'videos/' || CAST(doc_id AS VARCHAR) || '/transcript/transcript_tree.json' AS object_key,
       '{"kind":"transcript_tree","version":"8","raw":{"kind":"transcript_raw","version":"1",'
       || '"local_asr_model_label":"Qwen/Qwen3-ASR-1.7B"},'
       || '"transcript_structure_model":"qwen3.7-plus","transcript_business_frame_mode":'
       || '"section_polished_text_business_frame_text_and_query_graph_v1"}' AS generation
FROM documents
"""
SQL["parse_artifacts"] = """
SELECT doc_id AS video_id, CASE WHEN doc_id % 9 > 0 AND doc_id % 7 > 0 THEN lang END AS title,
       CASE WHEN doc_id % 9 > 0 AND doc_id % 7 > 0 THEN md5(text) END AS text_md5,
       CASE WHEN doc_id % 9 = 0 THEN 'empty' WHEN doc_id % 7 = 0 THEN 'corrupt' END AS reason
FROM documents
"""
SQL["pair_images_labels"] = """
SELECT doc_id AS stem, doc_id IN (SELECT doc_id FROM labels) AS paired
FROM documents WHERE doc_id % 13 > 0
"""
SQL["seeded_split"] = with_ctes(
    "SELECT stem, CASE WHEN is_val THEN 'val' ELSE 'train' END AS split FROM dataset_pairs",
    "dataset_pairs",
)
SQL["class_list"] = with_ctes("SELECT * FROM classes", "classes")
SQL["split_summary"] = with_ctes(
    """
SELECT count(*) AS images_total, count(*) FILTER (NOT is_val) AS images_train,
       count(*) FILTER (is_val) AS images_val, (SELECT count(*) FROM classes) AS classes
FROM dataset_pairs
""",
    "dataset_pairs", "classes",
)
SQL["data_yaml"] = with_ctes(
    """
SELECT dataset, 0::BIGINT AS part_no,
       concat('path: /data/export/', dataset, chr(10), 'train: images/train', chr(10),
              'val: images/val', chr(10), 'nc: ', count(*), chr(10), 'names:', chr(10),
              string_agg(concat('  ', class_id, ': ', name), chr(10) ORDER BY class_id), chr(10))
         AS data_yaml
FROM classes GROUP BY dataset
""",
    "classes",
)
SQL["validate_labels"] = with_ctes(
    """
SELECT doc_id AS stem, 1::BIGINT AS line_no, unnest(
  [[], ['class_out_of_range'], ['column_count'], ['coordinate_out_of_range'],
   ['class_out_of_range', 'coordinate_out_of_range'], ['coordinate_out_of_range']][doc_id % 6 + 1])
  AS reason FROM labels
UNION ALL
SELECT stem, NULL, 'duplicate_across_splits' FROM dataset_pairs
WHERE is_val AND content IN (SELECT content FROM dataset_pairs WHERE NOT is_val)
UNION ALL
SELECT doc_id, NULL, 'missing_label_file' FROM documents
WHERE doc_id % 13 > 0 AND doc_id NOT IN (SELECT doc_id FROM labels)
""",
    "dataset_pairs",
)
SQL["image_metrics"] = """
WITH g AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x:
             greatest(0, least(255, floor((x + 0.5::DOUBLE) * 255)))) AS v FROM embeddings),
p AS (SELECT g.vec_id, v, i // 8 AS y, i % 8 AS x, v[i + 1] AS c
      FROM g, (SELECT unnest(range(64)) AS i)),
l AS (SELECT vec_id, x, y, c,
             v[(CASE WHEN y = 0 THEN 1 ELSE y - 1 END) * 8 + x + 1]
             + v[(CASE WHEN y = 7 THEN 6 ELSE y + 1 END) * 8 + x + 1]
             + v[y * 8 + (CASE WHEN x = 0 THEN 1 ELSE x - 1 END) + 1]
             + v[y * 8 + (CASE WHEN x = 7 THEN 6 ELSE x + 1 END) + 1] - 4 * c AS lap FROM p),
s AS (SELECT vec_id, var_pop(lap) AS blur, avg(c) AS mean,
             avg(CASE WHEN c < 20 THEN 1.0 ELSE 0 END) AS dark,
             avg(CASE WHEN c > 245 THEN 1.0 ELSE 0 END) AS bright,
             abs(avg(c) FILTER (x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5)
               - avg(c) FILTER (NOT (x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5))) / 255 AS contrast,
             count(*) FILTER (c < 64) AS h1, count(*) FILTER (c >= 64 AND c < 128) AS h2,
             count(*) FILTER (c >= 128 AND c < 192) AS h3, count(*) FILTER (c >= 192) AS h4
      FROM l GROUP BY 1)
SELECT vec_id, 8::BIGINT AS image_width, round(blur, 6) AS blur_score,
       round(mean, 6) AS mean_brightness, round(dark, 6) AS dark_ratio,
       round(bright, 6) AS bright_ratio, round(contrast, 6) AS center_contrast,
       round(h2 / sqrt(h1 * h1 + h2 * h2 + h3 * h3 + h4 * h4), 6) AS histogram_2,
       round(h3 / sqrt(h1 * h1 + h2 * h2 + h3 * h3 + h4 * h4), 6) AS histogram_3,
       128::BIGINT AS bins
FROM s
"""
SQL["phash_pack"] = with_ctes("SELECT vec_id, phash FROM vec_hash", "vec_hash")
SQL["latest_state_stream"] = SQL["latest_state"]
# Events arrive in parts (event_id % 7 % 3): 2, 0, 1 and 0 again.
SQL["quarantined_updates"] = """
SELECT user_id AS id, event_type AS status, CAST(NULL AS BIGINT) AS updated_at, event_id AS seq,
       'unknown_time' AS reason
FROM events, (VALUES (1), (2)) AS again(n)
WHERE event_id % 50 = 0 AND (n = 1 OR event_id % 7 % 3 = 0)
"""
SQL["intake_stream"] = """
WITH e AS (SELECT user_id * 3 + event_id % 3 AS id,
       'dir/clip' || ['.mp4', '.MKV', '.avi', '', '.webm'][event_id % 5 + 1] AS filename,
       CAST(floor(value) AS BIGINT) - 3 AS size_bytes, event_id AS seq,
       CASE WHEN event_id % 5 IN (2, 3) THEN 'unsupported_suffix'
            WHEN floor(value) - 3 <= 0 THEN 'empty_file'
            WHEN floor(value) - 3 > 100 THEN 'too_large' END AS own, arrival
  FROM events JOIN (VALUES (2, 1), (0, 2), (1, 3), (0, 4)) AS p(part, arrival) ON event_id % 7 % 3 = part)
SELECT id, filename, size_bytes, seq, coalesce(own, CASE WHEN row_number() OVER (
  PARTITION BY id, own IS NULL ORDER BY arrival, seq) > 1 THEN 'duplicate_id' END) AS reason
FROM e
"""
SQL["parse_videos"] = with_ctes(
    """
SELECT video_id, section_index, frame_id, graph_id, round(score, 6) AS score, rank, matched,
       missing, negative_hits FROM (
  SELECT *, row_number() OVER (PARTITION BY video_id, section_index
                               ORDER BY score DESC, timestamp_ms, frame_id) AS rank
  FROM (SELECT p.video_id, p.section_index, p.frame_id, p.graph_id, k.timestamp_ms,
               coalesce(m.score, 0) AS score, coalesce(m.matched, '') AS matched,
               coalesce(m.missing, t.terms) AS missing,
               coalesce(m.negative_hits, '') AS negative_hits
        FROM pairs p JOIN members k USING (section_index, frame_id)
        JOIN (SELECT graph_id, string_agg(term, '|' ORDER BY n) AS terms FROM nodes GROUP BY 1) t
          ON t.graph_id = p.graph_id
        LEFT JOIN matches m ON m.frame_id = p.frame_id AND m.section_index = p.section_index))
""",
    "matches", "members",
    instead={
        "pairs": (
            """
SELECT video_id, section_index, frame_id, quality_score,
       'Brand#' || CAST((video_id + section_index) % 25 + 1 AS VARCHAR) AS graph_id,
       ['wiring_frame', 'operation_frame', 'completion_frame', 'alignment_frame',
        'overview_frame', 'other'][section_index % 6 + 1] AS frame_type,
       ([0.08, 0.08, 0.10, 0.05, 0.04, 0.06]::DOUBLE[])[section_index % 6 + 1] AS ideal
FROM members WHERE frame_id = representative_frame_id
""",
            ("members",),
        ),
        "scene_frames": (
            """
SELECT frame_id, blur_score FROM frames WHERE frame_id IN (SELECT frame_id FROM det)
""",
            ("frames", "det"),
        ),
    },
)
SQL["replaced_frames"] = with_ctes(
    """
SELECT video_id, frame_id, timestamp_ms FROM frames
WHERE video_id % 7 > 0 AND (video_id % 3 > 0 OR frame_id % 2 = 0)
""",
    "frames",
)
SQL["artifact_tables"] = """
SELECT doc_id AS video_id, lang, md5(text) AS text_md5 FROM documents
"""
SQL["image_sizes"] = """
WITH d AS (
  SELECT l_orderkey AS frame_id, l_suppkey % 50 * 12.0 + l_quantity * 6 AS x2, l_partkey % 40 * 9.0 + l_quantity * 5 AS y2
  FROM lineitem JOIN part ON l_partkey = p_partkey
)
SELECT frame_id,
       CASE frame_id % 4 WHEN 0 THEN greatest(1, CAST(ceil(max(x2)) AS BIGINT))
            WHEN 1 THEN greatest(960, CAST(ceil(max(x2)) AS BIGINT)) ELSE 960 END AS width,
       CASE frame_id % 4 WHEN 1 THEN greatest(1, CAST(ceil(max(y2)) AS BIGINT))
            WHEN 0 THEN greatest(540, CAST(ceil(max(y2)) AS BIGINT)) ELSE 540 END AS height,
       count(*) AS detections
FROM d GROUP BY frame_id
"""
