"""DuckDB twins of the registered queries, written independently of the Spark plans."""

from __future__ import annotations

RUN = "2024-01-02_00-00-00"

# Input adapters as common table expressions, in dependency order.
ADAPTERS = {
    "event_lines": """
        SELECT event_id, ts, run, ns, pod, container,
               concat(ns, '__', pod, '__', container, '__', run, '.log') AS filename,
               row_number() OVER (PARTITION BY run, ns, pod, container ORDER BY ts, event_id) AS line_no,
               line, strlen(line) AS n_bytes
        FROM (SELECT event_id, ts, strftime(ts, '%Y-%m-%d_00-00-00') AS run,
                     concat('ns', cast(user_id % 5 AS VARCHAR)) AS ns,
                     concat('pod-', cast(user_id % 20 AS VARCHAR)) AS pod,
                     CASE WHEN user_id % 20 < 10 THEN 'app' ELSE 'sidecar' END AS container,
                     concat(strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ'), ' ',
                       CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'WARNING'
                            WHEN 'purchase' THEN 'INFO' WHEN 'signup' THEN 'debug'
                            ELSE CASE WHEN event_id % 3 = 0 THEN 'errors_total warned'
                                      WHEN event_id % 3 = 1 THEN 'information' ELSE 'plain' END END,
                       ' user=', cast(user_id AS VARCHAR), ' ', props) AS line
              FROM events) e""",
    "log_files": """
        SELECT run, filename, ns, pod, container, cast(sum(n_bytes + 1) AS BIGINT) AS size_bytes,
               count(*) AS line_count, max(ts) AS mtime
        FROM event_lines GROUP BY run, filename, ns, pod, container""",
    "runs": """
        SELECT run, count(*) AS file_count, cast(sum(size_bytes) AS BIGINT) AS total_bytes
        FROM log_files GROUP BY run""",
    "archives": """
        SELECT concat('archive_', run, '.tar.gz') AS filename, run,
               cast(floor(total_bytes / 4) AS BIGINT) AS size_bytes
        FROM runs WHERE cast(substring(run, 9, 2) AS INT) % 2 = 0""",
    "offsets": """
        SELECT filename AS path,
               CASE m WHEN 0 THEN size_bytes WHEN 1 THEN cast(floor(size_bytes / 2) AS BIGINT)
                      ELSE size_bytes + 100 END AS byte_offset
        FROM (SELECT filename, size_bytes, cast(substring(pod, 5) AS INT) % 4 AS m FROM log_files) t
        WHERE m < 3
        UNION ALL
        SELECT concat('gone/', filename) AS path, size_bytes AS byte_offset
        FROM log_files WHERE pod = 'pod-7'""",
    "inventory": "SELECT DISTINCT ns, pod, concat(container, ', ', 'init') AS containers FROM event_lines",
    "containers": "SELECT ns, pod, trim(unnest(string_split(containers, ','))) AS container FROM inventory",
    "coverage": """
        SELECT DISTINCT ns, pod, container, cast(substring(pod, 5) AS INT) % 6 = 1 AS rotated
        FROM event_lines WHERE cast(substring(pod, 5) AS INT) % 3 <> 0""",
    "rotated_files": """
        SELECT ns, pod, container, concat('0.log.', substring(run, 1, 10)) AS name, size_bytes, run AS mtime
        FROM log_files WHERE run < '2024-01-06'""",
    "logged_lines": "SELECT * FROM event_lines UNION ALL SELECT * FROM event_lines WHERE event_id % 50 = 0",
    "api_lines": """
        SELECT 1 AS batch, ns, pod, container, ts, line FROM logged_lines
        WHERE ts < timestamp '2024-01-15 06:00:00'
        UNION ALL
        SELECT 2 AS batch, ns, pod, container, ts, line FROM logged_lines
        WHERE ts >= timestamp '2024-01-14 18:00:00'""",
    "selection": f"""
        SELECT cast(row_number() OVER (ORDER BY filename) - 1 AS INT) AS sel_idx, run, filename
        FROM (SELECT run, filename FROM log_files WHERE run = '{RUN}' ORDER BY filename LIMIT 4) t
        UNION ALL
        SELECT 4 AS sel_idx, run, min(filename) AS filename FROM log_files WHERE run = '{RUN}' GROUP BY run
        UNION ALL
        SELECT 5 AS sel_idx, 'no-run' AS run, 'no-file.log' AS filename
        UNION ALL
        SELECT 6 AS sel_idx, run, max(filename) AS filename FROM log_files WHERE run = '2024-01-03_00-00-00' GROUP BY run""",
    "doc_lines": """
        SELECT doc_id, cast(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS line_no,
               unnest(string_split(text, chr(10))) AS line, source AS ns,
               concat('doc-', cast(doc_id AS VARCHAR)) AS pod, lang AS container
        FROM documents""",
    "doc_positions": """
        SELECT ns, doc_id, line_no, strlen(line) AS n_bytes,
               cast(coalesce(sum(strlen(line) + 1) OVER (PARTITION BY ns ORDER BY doc_id, line_no
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_byte
        FROM doc_lines""",
    "doc_parts": "SELECT *, cast(floor(start_byte / 4096) AS BIGINT) AS part FROM doc_positions",
    "levels": """
        SELECT *, CASE WHEN contains(lower(line), 'error') THEN 'error' WHEN contains(lower(line), 'warn') THEN 'warn'
                       WHEN contains(lower(line), 'info') THEN 'info' WHEN contains(lower(line), 'debug') THEN 'debug'
                       ELSE 'none' END AS level
        FROM event_lines""",
    "file_index": """
        SELECT run, filename, ns, pod, container, cast(sum(n_bytes + 1) AS BIGINT) AS size_bytes,
               count(*) AS line_count,
               count(*) FILTER (level = 'error') AS error_count, count(*) FILTER (level = 'warn') AS warn_count,
               count(*) FILTER (level = 'info') AS info_count, count(*) FILTER (level = 'debug') AS debug_count
        FROM levels GROUP BY run, filename, ns, pod, container""",
    "file_heads": """
        SELECT run, filename, count(*) AS line_count,
               count(*) FILTER (level = 'error' AND line_no <= 5) AS error_count,
               count(*) FILTER (level = 'warn' AND line_no <= 5) AS warn_count,
               count(*) FILTER (level = 'info' AND line_no <= 5) AS info_count,
               count(*) FILTER (level = 'debug' AND line_no <= 5) AS debug_count
        FROM levels GROUP BY run, filename""",
    "results": """
        SELECT f.run, f.filename, f.ns, f.pod, f.container, f.size_bytes, f.line_count,
               f.error_count, f.warn_count, f.info_count, f.debug_count
        FROM file_index f JOIN runs r ON f.run = r.run""",
    "positions": """
        SELECT run, filename, event_id, line_no, line, n_bytes,
               cast(coalesce(sum(n_bytes + 1) OVER (PARTITION BY filename ORDER BY line_no
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_byte
        FROM event_lines""",
    "resumed": """
        SELECT f.filename, f.size_bytes, coalesce(o.byte_offset, 0) AS byte_offset,
               CASE WHEN o.byte_offset IS NULL OR f.size_bytes < o.byte_offset THEN 0
                    ELSE o.byte_offset END AS effective_offset
        FROM log_files f LEFT JOIN offsets o ON f.filename = o.path""",
    "counted": """
        SELECT run, filename, ns, pod, container, ts, event_id, line, line_no,
               count(*) OVER (PARTITION BY run, filename) AS lines FROM event_lines""",
    "whole_merge": """
        SELECT s.sel_idx, l.run, l.filename, l.line, l.line_no, l.lines,
               CASE WHEN length(split_part(l.line, ' ', 1)) >= 10 THEN split_part(l.line, ' ', 1) ELSE '' END AS ts_key,
               concat(l.pod, '/', l.container) AS label,
               CASE WHEN contains(lower(line), 'error') THEN 'error' WHEN contains(lower(line), 'warn') THEN 'warn'
                    WHEN contains(lower(line), 'debug') THEN 'debug' WHEN contains(lower(line), 'info') THEN 'info'
                    ELSE 'none' END AS level
        FROM selection s JOIN counted l ON s.run = l.run AND s.filename = l.filename""",
    "merged": "SELECT * FROM whole_merge WHERE line_no > lines - 5",
    "candidates": "SELECT * FROM containers c ANTI JOIN (SELECT * FROM coverage WHERE NOT rotated) v USING (ns, pod, container)",
    "phases": """
        SELECT 'node' AS phase, ns, pod, container, line FROM event_lines SEMI JOIN coverage USING (ns, pod, container)
        UNION ALL
        SELECT 'api' AS phase, ns, pod, container, line FROM event_lines
        WHERE (ns, pod, container) NOT IN (SELECT (ns, pod, container) FROM coverage)
        UNION ALL
        SELECT 'previous' AS phase, ns, pod, container, line FROM event_lines
        SEMI JOIN (SELECT * FROM coverage WHERE rotated) v USING (ns, pod, container)""",
    "expired": """
        SELECT run, total_bytes FROM runs
        WHERE try_strptime(run, '%Y-%m-%d_%H-%M-%S') < timestamp '2024-02-10 00:00:00' - interval 30 days""",
}

LINES = "run, filename, event_id, line"
FILES = "run, filename, ns, pod, container, size_bytes"
RESULT = ("run, filename, ns, pod, container, size_bytes, line_count, "
          "error_count, warn_count, info_count, debug_count")
COUNTS = "error_count, warn_count, info_count, debug_count"
POD_HIT = "(contains(lower(pod), 'pod-1') OR contains(lower(ns), 'pod-1') OR contains(lower(filename), 'pod-1'))"

BODIES = {
    "filter_level_error": rf"SELECT {LINES} FROM event_lines WHERE regexp_matches(line, '(?i)\berror\b')",
    "filter_level_warning": rf"SELECT {LINES} FROM event_lines WHERE regexp_matches(line, '(?i)\bwarn(ing)?\b')",
    "filter_level_info": rf"SELECT {LINES} FROM event_lines WHERE regexp_matches(line, '(?i)\binfo\b')",
    "filter_level_debug": rf"SELECT {LINES} FROM event_lines WHERE regexp_matches(line, '(?i)\bdebug\b')",
    "filter_level_all": f"SELECT {LINES} FROM event_lines",
    "filter_text": f"SELECT {LINES} FROM event_lines WHERE contains(lower(line), '\"k\": 6')",
    "filter_level_and_text": rf"""
        SELECT {LINES} FROM event_lines
        WHERE regexp_matches(line, '(?i)\berror\b') AND contains(lower(line), '"k": 6')""",
    "search_lines": f"""
        SELECT {LINES} FROM event_lines WHERE contains(lower(line), '"k": 6') AND ns IN ('ns2', 'ns3')
          AND run >= '2024-01-05' AND run <= '2024-01-10_99-99-99'""",
    "search_lines_indexed": f"""
        SELECT {LINES} FROM event_lines WHERE contains(lower(line), '"k": 6') AND ns IN ('ns2', 'ns3')
          AND run >= '2024-01-05' AND run <= '2024-01-10_99-99-99'""",
    "search_document_lines_indexed": "SELECT ns, doc_id, line_no, line FROM doc_lines WHERE contains(lower(line), 'über')",
    "search_no_filter": f"SELECT {RESULT} FROM results WHERE false",
    "search_document_lines": "SELECT ns, doc_id, line_no, line FROM doc_lines WHERE contains(lower(line), 'é')",
    "shown_line_count": rf"""
        SELECT run, filename,
               count(*) FILTER (regexp_matches(line, '(?i)\berror\b') AND contains(line, 'user=1')) AS shown_lines
        FROM event_lines WHERE run = '{RUN}' GROUP BY run, filename""",
    "viewer_level_counts": f"SELECT run, filename, {COUNTS} FROM file_heads WHERE run = '{RUN}'",
    "pattern_count_by_run": """
        SELECT run, count(*) FILTER (contains(line, 'user=1')) AS matches FROM event_lines GROUP BY run""",
    "files_by_namespace": f"SELECT {FILES} FROM log_files WHERE ns = 'ns2'",
    "files_by_ns_prefix": f"SELECT {FILES} FROM log_files WHERE starts_with(filename, 'ns2__')",
    "files_by_name": f"SELECT {FILES} FROM log_files WHERE contains(lower(filename), 'pod-1')",
    "run_files": f"SELECT {FILES} FROM log_files WHERE run = '{RUN}' ORDER BY filename",
    "run_files_like": f"SELECT {FILES} FROM log_files WHERE run = '{RUN}' AND filename ILIKE '%POD_1%SIDE%'",
    "files_with_problems": """
        SELECT run, filename, error_count, warn_count FROM file_index WHERE error_count > 0 OR warn_count > 0""",
    "files_modified_since": f"""
        SELECT {FILES} FROM log_files
        WHERE date_trunc('second', mtime) > timestamp '2024-01-15 00:00:00' - interval 300 seconds""",
    "file_line_counts": "SELECT run, filename, count(*) AS line_count FROM event_lines GROUP BY run, filename",
    "file_level_counts": f"SELECT run, filename, line_count, {COUNTS} FROM file_heads",
    "file_level_counts_exact": f"SELECT run, filename, line_count, {COUNTS} FROM file_index",
    "index_run": f"SELECT {RESULT} FROM file_index WHERE run = '{RUN}'",
    "run_totals": "SELECT run, file_count, total_bytes FROM runs",
    "run_count": """
        SELECT 'runs' AS kind, count(*) AS n FROM runs UNION ALL SELECT 'archives' AS kind, count(*) AS n FROM archives""",
    "dashboard_stats": """
        SELECT runs, files, zips, storage_bytes, last_run,
               CASE WHEN storage_bytes < 1024 THEN printf('%.1f B', storage_bytes::DOUBLE)
                    WHEN storage_bytes < 1048576 THEN printf('%.1f KB', storage_bytes / 1024)
                    WHEN storage_bytes < 1073741824 THEN printf('%.1f MB', storage_bytes / 1048576)
                    WHEN storage_bytes < 1099511627776 THEN printf('%.1f GB', storage_bytes / 1073741824)
                    ELSE printf('%.1f TB', storage_bytes / 1099511627776) END AS storage
        FROM (SELECT (SELECT count(*) FROM runs) AS runs,
                     cast((SELECT coalesce(sum(file_count), 0) FROM runs) AS BIGINT) AS files,
                     (SELECT count(*) FROM archives) AS zips,
                     cast((SELECT coalesce(sum(total_bytes), 0) FROM runs)
                        + (SELECT coalesce(sum(size_bytes), 0) FROM archives) AS BIGINT) AS storage_bytes,
                     coalesce((SELECT max(run) FROM runs), 'Never') AS last_run) t""",
    "distinct_namespaces": "SELECT DISTINCT ns FROM event_lines WHERE ns != '' ORDER BY ns",
    "run_namespaces": f"SELECT DISTINCT ns FROM event_lines WHERE run = '{RUN}' AND ns != '' ORDER BY ns",
    "list_runs": "SELECT DISTINCT run FROM event_lines ORDER BY run DESC",
    "runs_page": """
        SELECT rank, run, file_count, total_bytes
        FROM (SELECT *, row_number() OVER (ORDER BY run DESC) AS rank FROM runs) t WHERE rank BETWEEN 6 AND 15""",
    "list_archives": "SELECT filename, size_bytes FROM archives ORDER BY filename DESC",
    "archive_upsert": """
        SELECT filename, run, size_bytes, created_at
        FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY created_at DESC) AS n
              FROM (SELECT filename, run, size_bytes, 1.0::DOUBLE AS created_at FROM archives
                    UNION ALL
                    SELECT concat('archive_', run, '.tar.gz') AS filename, run,
                           cast(floor(total_bytes / 5) AS BIGINT) AS size_bytes,
                           CASE WHEN run < '2024-01-10' THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END AS created_at FROM runs) u) t
        WHERE n = 1""",
    "remove_run": """
        SELECT 'runs' AS kept_in, run, '' AS filename FROM runs WHERE run NOT IN (SELECT run FROM expired)
        UNION ALL
        SELECT 'log_files' AS kept_in, run, filename FROM log_files WHERE run NOT IN (SELECT run FROM expired)
        UNION ALL
        SELECT 'archives' AS kept_in, run, filename FROM archives a
        WHERE NOT EXISTS (SELECT 1 FROM expired e WHERE contains(a.filename, e.run))""",
    "archive_run_match": """
        SELECT a.filename, r.run, r.total_bytes FROM archives a JOIN runs r ON contains(a.filename, r.run)""",
    "run_with_archive": """
        SELECT r.run, r.total_bytes, a.filename IS NOT NULL AS has_archive, coalesce(a.size_bytes, 0) AS archive_bytes
        FROM runs r LEFT JOIN archives a ON a.filename = concat('archive_', r.run, '.tar.gz')""",
    "archives_by_namespace": """
        SELECT filename, run, size_bytes FROM archives WHERE run IN (SELECT run FROM log_files WHERE ns = 'ns2')""",
    "search_join": """
        SELECT f.run, f.filename, f.size_bytes, r.file_count, r.total_bytes FROM log_files f JOIN runs r ON f.run = r.run""",
    "search_pod": f"SELECT {RESULT} FROM results WHERE {POD_HIT}",
    "search_pod_like": f"""
        SELECT {RESULT} FROM results
        WHERE pod ILIKE '%POD_1%SIDE%' OR ns ILIKE '%POD_1%SIDE%' OR filename ILIKE '%POD_1%SIDE%'""",
    "search_date_range": f"SELECT {RESULT} FROM results WHERE run >= '2024-01-05' AND run <= '2024-01-10_99-99-99'",
    "search_all_filters": f"""
        SELECT {RESULT} FROM results
        WHERE {POD_HIT} AND ns = 'ns2' AND run >= '2024-01-05' AND run <= '2024-01-10_99-99-99'""",
    "search_count": f"SELECT count(*) AS results FROM results WHERE {POD_HIT}",
    "search_top500": f"""
        SELECT {RESULT}, row_number() OVER (ORDER BY run DESC, filename) AS rank
        FROM results WHERE run >= '2024' ORDER BY run DESC, filename LIMIT 500""",
    "search_sorted_by_size": f"""
        SELECT {RESULT} FROM results WHERE {POD_HIT} ORDER BY size_bytes DESC, run, filename""",
    "search_recent_runs": f"""
        SELECT {FILES} FROM log_files
        WHERE ns = 'ns2' AND contains(lower(filename), 'pod-1')
          AND run IN (SELECT DISTINCT run FROM log_files ORDER BY run DESC LIMIT 30)""",
    "head_n_per_file": "SELECT run, filename, line_no, event_id, line FROM event_lines WHERE line_no <= 5",
    "tail_n_per_file": "SELECT run, filename, line_no, event_id, line FROM counted WHERE line_no > lines - 5",
    "line_positions": "SELECT run, filename, event_id, line_no, start_byte FROM positions",
    "merge_view": """
        SELECT row_number() OVER (ORDER BY ts_key, sel_idx, line_no) AS pos, sel_idx,
               cast(sel_idx % 10 AS INT) AS source_group, label, ts_key, level, line_no, line
        FROM merged""",
    "merge_whole_files": """
        SELECT row_number() OVER (ORDER BY ts_key, sel_idx, line_no) AS pos, sel_idx, ts_key, line_no, line
        FROM whole_merge""",
    "archive_read_back": """
        SELECT run, filename, line_no, cast(coalesce(sum(n_bytes + 1) OVER (
                 PARTITION BY run, filename ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_byte,
               n_bytes, line
        FROM event_lines""",
    "committed_files": f"SELECT run, filename, size_bytes, line_count, {COUNTS} FROM results",
    "merge_all_files": """
        SELECT row_number() OVER (ORDER BY split_part(line, ' ', 1), run, filename, line_no) AS pos, run, filename, line_no, line
        FROM event_lines""",
    "merge_summary": "SELECT count(*) AS total_lines, count(DISTINCT sel_idx) AS sources FROM merged",
    "merged_filter_count": """
        SELECT count(*) AS visible FROM merged
        WHERE contains(lower(concat('[', label, '] ', line)), lower('] 2024-01-02T2'))""",
    "selection_join": f"""
        SELECT s.sel_idx, l.run, l.filename, l.event_id, l.line
        FROM selection s JOIN event_lines l ON s.run = l.run AND s.filename = l.filename""",
    "export_selection": f"SELECT {LINES} FROM event_lines SEMI JOIN selection USING (run, filename)",
    "doc_lines": "SELECT doc_id, line_no, line, ns, pod, container, strlen(line) AS n_bytes FROM doc_lines",
    "split_parts": "SELECT ns, doc_id, line_no, start_byte, n_bytes, part FROM doc_parts",
    "split_parts_summary": """
        SELECT ns, cast(sum(n_bytes + 1) AS BIGINT) AS total_bytes, count(DISTINCT part) AS parts
        FROM doc_parts GROUP BY ns""",
    "part_names": """
        SELECT DISTINCT ns, part,
               CASE WHEN part = 0 THEN concat(ns, '__all__text.log')
                    ELSE concat(ns, '__all__text.part', cast(part AS VARCHAR), '.log') END AS out_name
        FROM doc_parts""",
    "nonempty_outputs": r"""
        SELECT run, filename, cast(sum(n + 1) AS BIGINT) AS n_bytes
        FROM (SELECT *, CASE WHEN cast(substring(pod, 5) AS INT) % 4 = 0 THEN 0 ELSE n_bytes END AS n FROM event_lines
              WHERE regexp_matches(line, '(?i)\berror\b') AND contains(lower(line), '"k": 6')) t
        GROUP BY run, filename""",
    "offset_lookup": "SELECT filename, size_bytes, byte_offset FROM resumed",
    "rotation_detect": """
        SELECT filename, byte_offset, effective_offset, size_bytes < byte_offset AS rotated FROM resumed""",
    "new_bytes": "SELECT filename, size_bytes - effective_offset AS new_bytes FROM resumed",
    "files_with_new_data": "SELECT filename, size_bytes, byte_offset FROM resumed WHERE size_bytes > effective_offset",
    "incremental_lines": """
        SELECT p.filename, p.line_no, p.start_byte, p.line FROM positions p JOIN resumed r ON p.filename = r.filename
        WHERE p.start_byte + p.n_bytes + 1 > r.effective_offset""",
    "next_offsets": "SELECT filename AS path, cast(max(start_byte + n_bytes + 1) AS BIGINT) AS byte_offset FROM positions GROUP BY filename",
    "dead_offsets": "SELECT path, byte_offset FROM offsets WHERE path NOT IN (SELECT filename FROM log_files)",
    "offsets_explode": "SELECT path, byte_offset FROM offsets",
    "rotated_skip_bytes": """
        SELECT t.ns, t.pod, t.container, t.name, t.size_bytes,
               cast(CASE WHEN t.newest = 1 AND t.recent AND o.byte_offset > 0 AND t.size_bytes >= o.byte_offset
                         THEN o.byte_offset ELSE 0 END AS BIGINT) AS skip_bytes
        FROM (SELECT *, mtime > '2024-01-03_00-00-00' AS recent,
                     row_number() OVER (PARTITION BY ns, pod, container ORDER BY name DESC) AS newest
              FROM rotated_files) t
        LEFT JOIN offsets o ON o.path = concat(t.ns, '__', t.pod, '__', t.container, '__2024-01-05_00-00-00.log')""",
    "inventory_explode": "SELECT ns, pod, container FROM containers",
    "api_candidates": "SELECT ns, pod, container FROM candidates",
    "api_skip_existing": f"""
        SELECT ns, pod, container FROM containers
        ANTI JOIN (SELECT * FROM log_files WHERE run = '{RUN}' AND size_bytes > 0) f USING (ns, pod, container)""",
    "previous_only_lines": """
        SELECT concat(ns, '__', pod, '__', container, '__', run, '.previous.log') AS out_name, event_id, line
        FROM event_lines
        SEMI JOIN (SELECT * FROM containers SEMI JOIN (SELECT * FROM coverage WHERE rotated) v USING (ns, pod, container)) k
        USING (ns, pod, container)""",
    "api_since_window": """
        SELECT batch, ns, pod, container, line FROM api_lines
        WHERE ts >= timestamp '2024-01-15 00:00:00' - interval 60 seconds AND ts <= timestamp '2024-02-10 00:00:00'""",
    "overlap_dedup": """
        SELECT ns, pod, container, line FROM (
          SELECT ns, pod, container, ts, line, unnest(range(max(n))) FROM (
            SELECT batch, ns, pod, container, ts, line, count(*) AS n FROM api_lines
            GROUP BY batch, ns, pod, container, ts, line) c
          GROUP BY ns, pod, container, ts, line) t""",
    "union_rotated_active": """
        SELECT ns, pod, container, src_rank, name, cast(sum(size_bytes) AS BIGINT) AS size_bytes
        FROM (SELECT ns, pod, container, name, size_bytes, 0 AS src_rank FROM rotated_files
              UNION ALL
              SELECT ns, pod, container, '0.log' AS name, size_bytes, 1 AS src_rank
              FROM log_files WHERE run >= '2024-01-06') t
        GROUP BY ns, pod, container, src_rank, name""",
    "union_phases": "SELECT phase, ns, pod, container, line FROM phases",
    "phase_counts": """
        SELECT coalesce(phase, 'total') AS phase, cast(sum(n) AS BIGINT) AS containers
        FROM (SELECT phase, count(*) AS n FROM (SELECT DISTINCT phase, ns, pod, container FROM phases) d GROUP BY phase) c
        GROUP BY ROLLUP (phase)""",
    "expired_runs": "SELECT run, total_bytes FROM expired",
    "cleanup_counts": """
        SELECT 'dead_offsets' AS kind, count(*) AS n FROM offsets WHERE path NOT IN (SELECT filename FROM log_files)
        UNION ALL
        SELECT 'expired_runs' AS kind, count(*) AS n FROM expired""",
    "retention_next": "SELECT run, total_bytes FROM expired ORDER BY run LIMIT 1",
    "storage_usage": """
        SELECT used_bytes, used_bytes * 3 AS capacity_bytes,
               cast(floor(used_bytes / (used_bytes * 3) * 100) AS BIGINT) AS used_pct
        FROM (SELECT cast((SELECT sum(size_bytes) FROM log_files) + (SELECT sum(size_bytes) FROM archives) AS BIGINT)
                     AS used_bytes) t""",
    "capacity_cleanup": """
        SELECT run, size_bytes, used_before, used_before >= floor(total * 2 * 20 / 100) AND run <> newest AS dropped
        FROM (SELECT run, size_bytes, sum(size_bytes) OVER () AS total, max(run) OVER () AS newest,
                     cast(sum(size_bytes) OVER () - coalesce(sum(size_bytes) OVER
                          (ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS used_before
              FROM (SELECT r.run, r.total_bytes + coalesce(a.size_bytes, 0) AS size_bytes
                    FROM runs r LEFT JOIN archives a ON r.run = a.run) s) t""",
    "parse_filename": r"""
        SELECT filename, coalesce(p[1], '') AS ns, coalesce(p[2], '') AS pod, coalesce(p[3], '') AS container,
               coalesce(p[4], '') AS run
        FROM (SELECT filename, string_split(regexp_replace(filename, '\.[^.]*$', ''), '__') AS p
              FROM (SELECT DISTINCT unnest([filename, concat(ns, '__', pod, '.log'), concat(ns, '.log'),
                    concat(ns, '__a__', pod, '___', container, '.part2.log')]) AS filename FROM event_lines) n) t""",
    "parse_pod_dir": """
        SELECT dir, p[1] AS ns, p[2] AS pod, coalesce(p[3], '') AS uid
        FROM (SELECT dir, string_split(dir, '_') AS p
              FROM (SELECT DISTINCT unnest([concat(ns, '_', pod, '_uid-', container), concat(ns, '_', pod), ns]) AS dir
                    FROM event_lines) d) t WHERE len(p) >= 2""",
    "container_key": "SELECT DISTINCT concat(ns, '__', pod, '__', container) AS container_key FROM event_lines",
    "source_labels": """
        SELECT filename, replace(filename, '.log', '') AS display_name,
               CASE WHEN len(p) >= 3 THEN concat(p[2], '/', p[3]) ELSE filename END AS label
        FROM (SELECT filename, string_split(replace(filename, '.log', ''), '__') AS p
              FROM (SELECT DISTINCT unnest([filename, concat(ns, '__single.log')]) AS filename FROM event_lines) n) t""",
    "human_size": """
        SELECT filename, size_bytes,
               CASE WHEN size_bytes < 1024 THEN printf('%.1f B', size_bytes::DOUBLE)
                    WHEN size_bytes < 1048576 THEN printf('%.1f KB', size_bytes::DOUBLE / 1024)
                    WHEN size_bytes < 1073741824 THEN printf('%.1f MB', size_bytes::DOUBLE / 1048576)
                    WHEN size_bytes < 1099511627776 THEN printf('%.1f GB', size_bytes::DOUBLE / 1073741824)
                    ELSE printf('%.1f TB', size_bytes::DOUBLE / 1099511627776) END AS size
        FROM (SELECT filename, cast(size_bytes * (1::BIGINT << (10 * power)) AS BIGINT) AS size_bytes
              FROM log_files, (SELECT cast(unnest([0, 1, 2, 3, 4]) AS BIGINT) AS power) p) t""",
    "level_substring": "SELECT event_id, level FROM levels",
    "level_merged": """
        SELECT event_id, CASE WHEN contains(lower(line), 'error') THEN 'error' WHEN contains(lower(line), 'warn') THEN 'warn'
                              WHEN contains(lower(line), 'debug') THEN 'debug' WHEN contains(lower(line), 'info') THEN 'info'
                              ELSE 'none' END AS level FROM event_lines""",
    "level_regex": r"""
        SELECT event_id, CASE WHEN regexp_matches(lower(line), '\berror\b') THEN 'error'
                              WHEN regexp_matches(lower(line), '\bwarn') THEN 'warn'
                              WHEN regexp_matches(lower(line), '\bdebug\b') THEN 'debug'
                              WHEN regexp_matches(lower(line), '\binfo\b') THEN 'info' ELSE 'none' END AS level
        FROM event_lines""",
    "extract_ts": """
        SELECT origin, id, line_no,
               CASE WHEN length(split_part(line, ' ', 1)) >= 10 THEN split_part(line, ' ', 1) ELSE '' END AS ts_key
        FROM (SELECT 'events' AS origin, event_id AS id, cast(1 AS BIGINT) AS line_no, line FROM event_lines
              UNION ALL SELECT 'documents' AS origin, doc_id AS id, line_no, line FROM doc_lines) t""",
    "archive_dates": """
        SELECT filename, run, coalesce(strftime(try_strptime(run, '%Y-%m-%d_%H-%M-%S'), '%b %d, %Y  %H:%M'), '—') AS label
        FROM (SELECT filename, replace(replace(filename, 'archive_', ''), '.tar.gz', '') AS run FROM archives) t""",
    "run_bucket": "SELECT event_id, strftime(ts, '%Y-%m-%d_%H-%M-%S') AS run FROM events",
    "level_counts_tumbling": """
        SELECT strftime(time_bucket(interval '4 hours', ts, timestamp '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS window_start, ns,
               count(*) FILTER (level = 'error') AS error_count, count(*) FILTER (level = 'warn') AS warn_count,
               count(*) FILTER (level = 'info') AS info_count, count(*) FILTER (level = 'debug') AS debug_count
        FROM levels GROUP BY 1, 2""",
    "level_counts_daily": """
        SELECT strftime(ts, '%Y-%m-%d') AS day, ns, pod,
               count(*) FILTER (level = 'error') AS error_count, count(*) FILTER (level = 'warn') AS warn_count,
               count(*) FILTER (level = 'info') AS info_count, count(*) FILTER (level = 'debug') AS debug_count
        FROM levels GROUP BY 1, 2, 3""",
}


def _needed(body: str, found: set[str]) -> set[str]:
    """Adapters a statement refers to, directly or through other adapters."""
    words = set(body.replace("(", " ").replace(")", " ").replace(",", " ").split())
    for name, text in ADAPTERS.items():
        if name in words and name not in found:
            found.add(name)
            _needed(text, found)
    return found


def statement(body: str) -> str:
    used = _needed(body, set())
    tables = [f"{name} AS ({text})" for name, text in ADAPTERS.items() if name in used]
    return f"WITH {', '.join(tables)}\n{body}" if tables else body


def statements() -> dict[str, str]:
    return {name: statement(body) for name, body in BODIES.items()}
