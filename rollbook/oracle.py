"""SQL for each registered query, written independently of the Spark code."""

from __future__ import annotations

_ACTIVITIES = """
activities AS (
  SELECT o_orderkey AS id, o_orderpriority AS nama_kegiatan, CAST(o_orderdate AS DATE) AS created_at,
         o_custkey AS users_id, CAST(o_orderkey % 30 AS INTEGER) AS team_id
  FROM orders
),
listed AS (
  SELECT a.*, u.c_name AS created_by, t.n_name AS tim
  FROM activities a
  JOIN customer u ON a.users_id = u.c_custkey * 2
  LEFT JOIN nation t ON a.team_id = t.n_nationkey
)
"""

_STAFF = """
staff AS (
  SELECT o_orderkey, o_orderpriority,
         'CUSTOMER#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS sekolah_id
  FROM orders
)
"""

_ACCESS = """
links AS (SELECT DISTINCT l_suppkey AS user_id, l_partkey AS permission_id FROM lineitem),
permissions AS (
  SELECT p_partkey AS id,
         CASE WHEN p_size <> 7 THEN p_brand || '-' || CAST(p_partkey AS VARCHAR) END AS code
  FROM part
),
users AS (SELECT s_suppkey AS id, s_name AS nama FROM supplier)
"""

_UPSERT = """
WITH target AS (
  SELECT o_orderkey * 2 AS k, o_orderstatus AS status, o_orderpriority AS note, o_totalprice AS amount
  FROM orders
),
staged AS (
  SELECT DISTINCT ON (l_orderkey) l_orderkey AS k, nullif(l_returnflag, 'R') AS status,
         l_linestatus AS note, l_extendedprice AS amount
  FROM lineitem
  ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
           l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate
)
SELECT t.k, s.status, t.note, s.amount FROM target t JOIN staged s USING (k)
UNION ALL
SELECT t.* FROM target t WHERE NOT EXISTS (SELECT 1 FROM staged s WHERE s.k = t.k)
UNION ALL
SELECT s.* FROM staged s WHERE NOT EXISTS (SELECT 1 FROM target t WHERE t.k = s.k)
"""

_DATES = """
dates AS (
  SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_orderkey % 5 AS turn,
         CASE o_orderkey % 5
           WHEN 0 THEN ' ' || CAST(date_diff('day', DATE '1899-12-30', CAST(o_orderdate AS DATE)) AS VARCHAR) || ' '
           WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d')
           WHEN 2 THEN '   '
           WHEN 3 THEN strftime(o_orderdate, '%d/%m/%Y')
         END AS raw
  FROM orders
)
"""

_REQUESTS = """
requests AS (
  SELECT event_id AS request_id, event_id // 2 AS id, CAST(user_id % 25 AS INTEGER) AS user_id,
         CASE WHEN event_type = 'error' THEN 'admin' ELSE 'user' END AS role
  FROM events
)
"""

_FAULTS = """
WITH rows AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id,
         CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 11 <> 1 THEN o_orderpriority END AS nama,
         CASE WHEN o_orderkey % 11 = 2 THEN 'x' ELSE CAST(o_orderkey % 17 AS VARCHAR) END AS total_peserta,
         '14abc' AS sasaran_peserta,
         CASE WHEN o_orderkey % 11 = 3 THEN 'boss' WHEN o_orderkey % 11 = 4 THEN 'admin' END AS role,
         o_custkey AS users_id
  FROM orders
),
judged AS (
  SELECT *, concat_ws('; ',
    CASE WHEN nama IS NULL OR nama = '' THEN 'nama: missing' END,
    CASE WHEN TRY_CAST(total_peserta AS INTEGER) > 14 THEN 'total_peserta: exceeds sasaran_peserta' END,
    CASE WHEN total_peserta = 'x' THEN 'total_peserta: not a number' END,
    CASE WHEN role NOT IN ('admin', 'user') THEN 'role: not allowed' END,
    CASE WHEN users_id NOT IN (SELECT c_custkey * 2 FROM customer)
         THEN 'users_id: not found' END) AS errors
  FROM rows
)
"""

_PAGE_ORDER = (
    "CAST(l_shipdate AS DATE) DESC, l_partkey, l_suppkey, l_quantity, l_extendedprice, "
    "l_orderkey, l_linenumber, l_discount, l_tax, l_returnflag, l_linestatus"
)

_LINE_ORDER = (
    "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, "
    "l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
)

ORACLE: dict[str, str] = {
    "page_list": """
        SELECT *, (SELECT count(*) FROM supplier) AS total,
               (SELECT CAST(ceil(count(*) / 10.0) AS BIGINT) FROM supplier) AS pages
        FROM supplier ORDER BY s_suppkey LIMIT 10 OFFSET 20
    """,
    "page_envelope": """
        WITH cut AS (SELECT p_name, p_partkey FROM part ORDER BY p_name NULLS LAST, p_partkey
                     LIMIT 10 OFFSET 10)
        SELECT CAST(2 AS BIGINT) AS page, CAST(10 AS BIGINT) AS "limit",
               (SELECT count(*) FROM part) AS total,
               (SELECT CAST(ceil(count(*) / 10.0) AS BIGINT) FROM part) AS pages,
               string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_name, p_partkey) AS keys
        FROM cut
    """,
    "user_list": """
        SELECT c_custkey AS id, c_name AS nama, c_mktsegment, (SELECT count(*) FROM customer) AS total
        FROM customer
    """,
    "search_multi": r"""
        SELECT * FROM customer
        WHERE c_name ILIKE 'mach' ESCAPE '\' OR c_name ILIKE '%mach%' ESCAPE '\'
           OR c_mktsegment ILIKE '%mach%' ESCAPE '\'
    """,
    "search_page": """
        WITH hits AS (SELECT * FROM part WHERE p_name ILIKE '%RING%')
        SELECT *, (SELECT count(*) FROM hits) AS total,
               (SELECT CAST(ceil(count(*) / 15.0) AS BIGINT) FROM hits) AS pages
        FROM hits ORDER BY p_name NULLS LAST, p_partkey LIMIT 15 OFFSET 15
    """,
    "search_pattern": r"""
        SELECT p_partkey, p_name, 'live' AS form FROM part WHERE p_name ILIKE '%r_ng%'
        UNION ALL
        SELECT p_partkey, p_name, 'literal' FROM part WHERE p_name ILIKE '%r\_ng%' ESCAPE '\'
        UNION ALL
        SELECT p_partkey, p_name, 'escape' FROM part WHERE p_name ILIKE '%ring%'
        UNION ALL
        SELECT p_partkey, p_name, 'percent' FROM part WHERE p_name ILIKE '%ring\%' ESCAPE '\'
    """,
    "search_requests": """
        WITH texts AS (
          SELECT source, lang, min(substr(text, 21, 9)) AS head, max(substr(text, 41, 6)) AS tail
          FROM documents GROUP BY source, lang
        ),
        requests AS (
          SELECT source || ' ' || lang || ' head' AS request_id, head AS q FROM texts
          UNION ALL SELECT source || ' ' || lang || ' short', substr(tail, 1, 2) FROM texts
          UNION ALL SELECT source || ' ' || lang || ' two', substr(head, 1, 5) || '%' || tail FROM texts
          UNION ALL SELECT source || ' ' || lang || ' one', tail || '_' || source FROM texts
        )
        SELECT request_id, doc_id FROM (SELECT request_id, translate(q, 'aeiou', 'AEIOU') AS q FROM requests) JOIN documents
          ON text ILIKE '%' || q || '%' OR source ILIKE q
    """,
    "search_documents": """
        SELECT doc_id, lang, source, n_chars FROM documents
        WHERE lang ILIKE 'DE' OR source ILIKE '%DE%' OR text ILIKE '%DE%'
    """,
    "page_lookups": f"""
        WITH {_ACTIVITIES}
        SELECT *, (SELECT count(*) FROM activities) AS total,
               (SELECT CAST(ceil(count(*) / 10.0) AS BIGINT) FROM activities) AS pages
        FROM listed ORDER BY created_at DESC NULLS FIRST, id LIMIT 10 OFFSET 10
    """,
    "search_lookups": f"""
        WITH {_ACTIVITIES},
        found AS (SELECT * FROM listed WHERE nama_kegiatan ILIKE '%urg%')
        SELECT *, (SELECT count(*) FROM found) AS total,
               (SELECT CAST(ceil(count(*) / 25.0) AS BIGINT) FROM found) AS pages
        FROM found ORDER BY created_at DESC NULLS FIRST, id LIMIT 25 OFFSET 50
    """,
    "all_lookups": f"WITH {_ACTIVITIES} SELECT * FROM listed",
    "totals_base_joined": f"""
        WITH {_ACTIVITIES},
        n AS (SELECT 'base' AS kind, count(*) AS total FROM activities
              UNION ALL SELECT 'joined', count(*) FROM listed)
        SELECT CAST(1 AS BIGINT) AS page, CAST(7 AS BIGINT) AS "limit", total,
               CAST(ceil(total / 7.0) AS BIGINT) AS pages, kind
        FROM n
    """,
    "by_key_set": """
        SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
               CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority
        FROM orders WHERE o_custkey IN (SELECT user_id FROM events)
    """,
    "by_key_text": """
        SELECT * FROM customer WHERE c_custkey IN (
          SELECT CAST(regexp_replace(props, '[^0-9]+', '', 'g') AS BIGINT) FROM events
          WHERE regexp_replace(props, '[^0-9]+', '', 'g') <> '')
    """,
    "children_page": f"""
        WITH {_STAFF},
        mine AS (SELECT * FROM staff
                 WHERE lower(sekolah_id) = 'customer#000000007' AND o_orderpriority ILIKE '%i%'),
        cut AS (SELECT * FROM mine ORDER BY o_orderpriority NULLS LAST, o_orderkey LIMIT 3)
        SELECT c_custkey, c_mktsegment, lower(c_name) AS parent_id,
               (SELECT count(*) FROM mine) AS total,
               (SELECT CAST(ceil(count(*) / 3.0) AS BIGINT) FROM mine) AS pages,
               CAST(1 AS BIGINT) AS page, CAST(3 AS BIGINT) AS "limit",
               coalesce((SELECT string_agg(CAST(o_orderkey AS VARCHAR), ','
                                           ORDER BY o_orderpriority, o_orderkey) FROM cut), '') AS keys
        FROM customer WHERE lower(c_name) = 'customer#000000007'
    """,
    "children_pages": f"""
        WITH {_STAFF},
        ranked AS (
          SELECT *, lower(sekolah_id) AS parent_id,
                 row_number() OVER (PARTITION BY lower(sekolah_id)
                                    ORDER BY o_orderpriority NULLS LAST, o_orderkey) AS rn
          FROM staff
        ),
        pages AS (
          SELECT parent_id, count(*) AS total,
                 string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY rn)
                   FILTER (WHERE rn BETWEEN 4 AND 6) AS keys
          FROM ranked GROUP BY parent_id
        )
        SELECT c_custkey, lower(c_name) AS parent_id, coalesce(total, 0) AS total,
               CAST(ceil(coalesce(total, 0) / 3.0) AS BIGINT) AS pages, coalesce(keys, '') AS keys
        FROM customer LEFT JOIN pages ON lower(c_name) = parent_id
    """,
    "children_pages_long": """
        WITH ranked AS (
          SELECT *, upper(p_brand) AS brand,
                 row_number() OVER (PARTITION BY p_brand ORDER BY p_name NULLS LAST, p_partkey) AS rn
          FROM part
        )
        SELECT brand, count(*) AS total, CAST(ceil(count(*) / 1000.0) AS BIGINT) AS pages,
               string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY rn) FILTER (WHERE rn <= 1000) AS keys
        FROM ranked GROUP BY brand
    """,
    "cast_order_blank": """
        SELECT CAST(p_partkey AS VARCHAR) AS no,
               CASE WHEN p_size >= 10 THEN p_brand ELSE '' END AS lptk,
               CASE WHEN p_size < 40 THEN CAST(p_size AS VARCHAR) ELSE '' END AS tahap
        FROM part ORDER BY p_partkey LIMIT 20 OFFSET 80
    """,
    "all_pages": """
        WITH numbered AS (
          SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day,
                 row_number() OVER (ORDER BY CAST(o_orderdate AS DATE) DESC NULLS FIRST, o_orderkey) - 1 AS n
          FROM orders
        )
        SELECT o_orderkey, day, CAST(n // 100 + 1 AS BIGINT) AS page_no,
               CAST(n % 100 + 1 AS BIGINT) AS position
        FROM numbered
    """,
    "distribution": """
        WITH people AS (SELECT c_mktsegment, nullif(c_nationkey, 3) AS c_nationkey FROM customer),
        counts AS (
          SELECT 'c_mktsegment' AS dimension, c_mktsegment AS value, count(*) AS n
          FROM people GROUP BY c_mktsegment
          UNION ALL
          SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR), count(*) FROM people GROUP BY c_nationkey
        )
        SELECT dimension, value, n,
               CAST(n AS DOUBLE) / CAST((SELECT count(*) FROM people) AS DOUBLE) AS share
        FROM counts
    """,
    "cross_distribution": """
        WITH rows AS (
          SELECT CAST(o_orderstatus AS VARCHAR) AS s, nullif(o_orderpriority, '5-LOW') AS p, CAST(o_custkey AS VARCHAR) AS c FROM orders
        ),
        ts AS (SELECT s FROM rows WHERE s IS NOT NULL GROUP BY s ORDER BY count(*) DESC, s LIMIT 12),
        tp AS (SELECT p FROM rows WHERE p IS NOT NULL GROUP BY p ORDER BY count(*) DESC, p LIMIT 12),
        tc AS (SELECT c FROM rows WHERE c IS NOT NULL GROUP BY c ORDER BY count(*) DESC, c LIMIT 12),
        marked AS (
          SELECT CASE WHEN s IN (FROM ts) THEN s END AS s, CASE WHEN s IS NULL THEN 'null' WHEN s IN (FROM ts) THEN 'value' ELSE 'other' END AS sk,
                 CASE WHEN p IN (FROM tp) THEN p END AS p, CASE WHEN p IS NULL THEN 'null' WHEN p IN (FROM tp) THEN 'value' ELSE 'other' END AS pk,
                 CASE WHEN c IN (FROM tc) THEN c END AS c, CASE WHEN c IS NULL THEN 'null' WHEN c IN (FROM tc) THEN 'value' ELSE 'other' END AS ck
          FROM rows
        )
        SELECT concat_ws(',', CASE WHEN grouping(sk) = 0 THEN 'status' END, CASE WHEN grouping(pk) = 0 THEN 'priority' END,
                         CASE WHEN grouping(ck) = 0 THEN 'customer' END) AS dimensions,
               s AS status, coalesce(sk, 'all') AS status_is, p AS priority, coalesce(pk, 'all') AS priority_is,
               c AS customer, coalesce(ck, 'all') AS customer_is, count(*) AS n, count(*) / (SELECT count(*) FROM rows) AS share
        FROM marked GROUP BY GROUPING SETS ((s, sk, p, pk), (s, sk, c, ck), (p, pk, c, ck), (s, sk, p, pk, c, ck))
    """,
    "statistics_feed": """
        SELECT l_orderkey, l_linenumber, l_returnflag, (SELECT count(*) FROM lineitem) AS total
        FROM lineitem
    """,
    "codes_per_user": f"""
        WITH {_ACCESS},
        arrays AS (
          SELECT user_id, string_agg(code, ',' ORDER BY code) AS codes
          FROM links JOIN permissions ON permission_id = id WHERE code IS NOT NULL GROUP BY user_id
        )
        SELECT id, nama, coalesce(codes, '') AS codes FROM users LEFT JOIN arrays ON id = user_id
    """,
    "codes_of_one_user": f"""
        WITH {_ACCESS},
        arrays AS (
          SELECT user_id, string_agg(code, ',' ORDER BY code) AS codes
          FROM links JOIN permissions ON permission_id = id WHERE code IS NOT NULL GROUP BY user_id
        )
        SELECT id, nama, coalesce(codes, '') AS codes
        FROM users LEFT JOIN arrays ON id = user_id WHERE id IN (1, 7)
        UNION ALL SELECT id, 'found', '' FROM users WHERE id IN (1, 7)
        UNION ALL SELECT max(id) + 1, 'not_found', '' FROM users
    """,
    "codes_of_requested": f"""
        WITH {_ACCESS},
        requests AS (
          SELECT l_orderkey || '-' || l_linenumber AS request_id, l_suppkey * 2 AS asked FROM lineitem
        ),
        arrays AS (
          SELECT user_id, string_agg(code, ',' ORDER BY code) AS codes
          FROM links JOIN permissions ON permission_id = id WHERE code IS NOT NULL GROUP BY user_id
        )
        SELECT id, nama, coalesce(codes, '') AS codes
        FROM users LEFT JOIN arrays ON id = user_id WHERE id IN (SELECT asked FROM requests)
        UNION ALL
        SELECT asked, CASE WHEN id IS NULL THEN 'not_found' ELSE 'found' END, request_id
        FROM requests LEFT JOIN users ON asked = id
    """,
    "codes_in_rows": f"""
        WITH {_ACCESS}
        SELECT user_id, code, row_number() OVER (PARTITION BY user_id ORDER BY code) AS position
        FROM links JOIN permissions ON permission_id = id WHERE code IS NOT NULL
    """,
    "permission_codes": f"""
        WITH {_ACCESS}
        SELECT user_id, code FROM links JOIN permissions ON permission_id = id
    """,
    "has_access": """
        WITH users AS (
          SELECT c_custkey AS id,
                 CASE WHEN c_acctbal > 9000 THEN 'admin' WHEN c_acctbal > 0 THEN 'user' END AS role
          FROM customer
        )
        SELECT id, role,
               coalesce(role = 'admin', false) OR EXISTS (
                 SELECT 1 FROM orders WHERE o_custkey * 2 = id) AS allowed
        FROM users
    """,
    "replace_set": f"""
        WITH {_ACCESS},
        requests AS (
          SELECT c_custkey AS request_id, c_custkey // 4 AS user_id,
                 CASE c_nationkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'empty' WHEN 2 THEN 'twice'
                 ELSE 'three' END AS form
          FROM customer
        ),
        judged AS (
          SELECT *, CASE WHEN user_id NOT IN (SELECT id FROM users) THEN 'not_found'
                         WHEN form = 'none' THEN 'untouched' WHEN form = 'twice' THEN 'rejected'
                         ELSE 'applied' END AS status
          FROM requests
        ),
        final AS (
          SELECT DISTINCT ON (user_id) user_id, request_id, form FROM judged
          WHERE status = 'applied' ORDER BY user_id, request_id DESC
        )
        SELECT 'link' AS kind, user_id, permission_id FROM links
        WHERE user_id NOT IN (SELECT user_id FROM final)
        UNION ALL
        SELECT 'link', user_id, request_id + step FROM final, (VALUES (0), (1), (2)) AS steps (step)
        WHERE form = 'three'
        UNION ALL
        SELECT status, -1, count(*) FROM judged GROUP BY status
    """,
    "assign_codes": f"""
        WITH {_ACCESS},
        requests AS (
          SELECT l_suppkey + l_linenumber AS user_id, l_partkey, code
          FROM lineitem JOIN permissions ON l_partkey = id
        )
        SELECT DISTINCT 'link' AS kind, user_id, l_partkey AS permission_id FROM requests
        WHERE code IS NOT NULL AND user_id IN (SELECT id FROM users)
        UNION ALL
        SELECT CASE WHEN user_id IN (SELECT id FROM users) THEN 'assigned' ELSE 'not_found' END,
               -1, count(*)
        FROM requests GROUP BY 1
    """,
    "dedupe_by_key": f"""
        SELECT DISTINCT ON (l_orderkey, l_linenumber)
               * REPLACE (CAST(l_shipdate AS DATE) AS l_shipdate)
        FROM lineitem ORDER BY {_LINE_ORDER}
    """,
    "upsert": _UPSERT,
    "upsert_large": _UPSERT,
    "normalise_dates": f"""
        WITH {_DATES}
        SELECT o_orderkey, raw, CASE WHEN turn IN (0, 1) THEN day END AS mulai,
               CASE WHEN turn = 1 OR (turn = 0 AND CAST(trim(raw) AS INTEGER) >= 36000)
                    THEN day END AS guarded
        FROM dates
    """,
    "normalise_ints": """
        WITH sizes AS (
          SELECT p_partkey, p_name, p_size,
                 CASE WHEN p_size < 10 THEN '  ' || CAST(p_size AS VARCHAR) || ' '
                      WHEN p_size < 20 THEN '  ' WHEN p_size < 45 THEN CAST(p_size AS VARCHAR) END AS raw
          FROM part
        )
        SELECT p_partkey, p_name, raw, CAST(nullif(trim(raw), '') AS INTEGER) AS strict,
               CAST(NULL AS INTEGER) AS lenient,
               CASE WHEN p_size < 10 OR p_size BETWEEN 20 AND 44 THEN CAST(p_size AS BIGINT) END AS leading
        FROM sizes
    """,
    "append_normalised": f"""
        WITH {_DATES}
        SELECT o_custkey AS users_id, o_orderpriority AS nama_kegiatan,
               CAST(o_orderdate AS DATE) AS tanggal_mulai, CAST(o_orderkey AS INTEGER) AS tahun,
               '2024-01-01 00:00:00' AS created_at
        FROM orders
        UNION ALL
        SELECT 7, o_orderstatus, CASE WHEN turn IN (0, 1) THEN day END, CAST(o_orderkey AS INTEGER),
               '2024-06-01 00:00:00'
        FROM orders JOIN dates USING (o_orderkey)
    """,
    "csv_positional": """
        SELECT c_custkey, c_name, c_acctbal,
               CASE c_nationkey % 3 WHEN 0 THEN '' WHEN 1
                    THEN 'a "b", ' || c_mktsegment || chr(10) || 'x' END AS nick
        FROM customer
    """,
    "csv_by_name": """
        SELECT CAST(l_orderkey AS VARCHAR) AS nama, CAST(NULL AS VARCHAR) AS kabupaten,
               CAST(NULL AS VARCHAR) AS instansi, 'a;b ' || l_returnflag AS jabatan,
               CAST(NULL AS VARCHAR) AS alamat, CAST(NULL AS VARCHAR) AS jenjang,
               CASE WHEN l_linenumber > 2 THEN l_linestatus ELSE '' END AS peran, ';' AS sep
        FROM lineitem
    """,
    "csv_mixed": """
        SELECT l_orderkey || '-' || l_linenumber AS nama,
               CASE WHEN l_linenumber % 3 <> 1 AND l_linenumber > 2 THEN l_linestatus END AS peran,
               CASE WHEN l_linenumber % 3 <> 2 THEN 'x;y,' || l_returnflag END AS jabatan
        FROM lineitem
    """,
    "csv_unclosed": """
        SELECT p_brand AS brand, sum(CASE WHEN p_size % 7 = 0 THEN 1 ELSE 0 END) % 2 = 1 AS unclosed,
               CASE WHEN max(n) > 0 THEN 'unterminated quoted field' ELSE 'loaded' END AS whole,
               CASE WHEN max(n) > 0 THEN 'unterminated quoted field' ELSE 'loaded' END AS pieces
        FROM part,
             (SELECT count(*) AS n FROM (SELECT p_brand FROM part WHERE p_size % 7 = 0
              GROUP BY p_brand HAVING count(*) % 2 = 1))
        GROUP BY p_brand
    """,
    "header_rules": """
        SELECT c_custkey,
               '"' || lower(c_mktsegment) || ' ' || chr(9) || ' of  ' || lower(c_name) || '"' AS trim_lower,
               '_"' || lower(c_mktsegment) || '_of_' || lower(c_name) || '"_' AS underscore,
               lower(c_mktsegment) || ' ' || chr(9) || ' of  ' || lower(c_name) AS "unquote"
        FROM customer
    """,
    "merge_ranges": """
        WITH top AS (SELECT max(o_orderkey) AS t FROM orders),
        late AS (
          SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE o_orderkey + t END AS k, 'late ' || o_orderstatus AS status
          FROM orders, top WHERE o_orderkey * 3 > t * 2
        )
        SELECT coalesce(o.o_orderkey, l.k) AS k, coalesce(l.status, o.o_orderstatus) AS status,
               CASE WHEN o.o_orderkey IS NULL THEN 'new' ELSE o.o_orderpriority END AS note
        FROM orders o FULL JOIN late l ON l.k = o.o_orderkey
    """,
    "publish_snapshot": "SELECT p_partkey, p_brand, p_size + 1 AS p_size FROM part",
    "ingest_dir": f"""
        WITH known AS (
          SELECT o_orderkey * 2 AS k, o_orderstatus AS status, o_orderpriority AS note
          FROM orders
        ),
        lines AS (
          SELECT DISTINCT ON (l_orderkey) l_orderkey AS k, l_returnflag AS status, l_linestatus AS note
          FROM lineitem ORDER BY {_LINE_ORDER}
        )
        SELECT k, coalesce(l.status, o.status) AS status, coalesce(o.note, l.note) AS note
        FROM known o FULL JOIN lines l USING (k)
    """,
    "delete_by_key": """
        WITH requests AS (
          SELECT o_orderkey AS request_id, o_orderkey // 2 * 4 AS l_orderkey FROM orders
        )
        SELECT l_orderkey, l_linenumber, l_partkey,
               CASE WHEN l_orderkey IN (SELECT l_orderkey FROM requests)
                 THEN 'affected' ELSE 'after' END AS side
        FROM lineitem
        UNION ALL
        SELECT request_id, NULL, NULL,
               CASE WHEN l_orderkey IN (SELECT l_orderkey FROM lineitem)
                 AND request_id = min(request_id) OVER (PARTITION BY l_orderkey)
                 THEN 'deleted' ELSE 'not_found' END
        FROM requests
    """,
    "delete_owned": f"""
        WITH {_REQUESTS},
        allowed AS (
          SELECT request_id, id FROM requests JOIN orders ON id = o_orderkey
          WHERE role = 'admin' OR o_custkey % 25 = user_id
        ),
        firsts AS (SELECT id, min(request_id) AS request_id FROM allowed GROUP BY id)
        SELECT 'request' AS kind, request_id AS id,
               CASE WHEN request_id IN (SELECT request_id FROM firsts) THEN 'deleted' ELSE 'refused' END AS status
        FROM requests
        UNION ALL
        SELECT 'kept', o_orderkey, '' FROM orders WHERE o_orderkey NOT IN (SELECT id FROM firsts)
    """,
    "delete_scoped": f"""
        WITH {_REQUESTS},
        allowed AS (
          SELECT request_id, id FROM requests JOIN orders ON id = o_orderkey
          WHERE role = 'admin'
             OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = user_id)
        ),
        firsts AS (SELECT id, min(request_id) AS request_id FROM allowed GROUP BY id)
        SELECT 'request' AS kind, request_id AS id,
               CASE WHEN request_id IN (SELECT request_id FROM firsts) THEN 'deleted' ELSE 'refused' END AS status
        FROM requests
        UNION ALL
        SELECT 'kept', o_orderkey, '' FROM orders WHERE o_orderkey NOT IN (SELECT id FROM firsts)
    """,
    "delete_group": f"""
        WITH {_REQUESTS},
        sizes AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey),
        judged AS (
          SELECT r.*, role = 'admin' OR EXISTS (
            SELECT 1 FROM orders WHERE o_orderkey = r.id AND o_custkey % 25 = r.user_id) AS may
          FROM requests r
        ),
        firsts AS (SELECT id, min(request_id) AS request_id FROM judged WHERE may GROUP BY id)
        SELECT 'request' AS kind, j.request_id AS id,
               CASE WHEN NOT may THEN 'refused' WHEN f.id IS NOT NULL AND n IS NOT NULL THEN 'deleted'
                    ELSE 'already_empty' END AS status,
               CASE WHEN f.id IS NOT NULL AND n IS NOT NULL THEN n ELSE 0 END AS rows
        FROM judged j
        LEFT JOIN firsts f ON f.id = j.id AND f.request_id = j.request_id
        LEFT JOIN sizes ON l_orderkey = j.id
        UNION ALL
        SELECT 'kept', l_orderkey, '', n FROM sizes WHERE l_orderkey NOT IN (SELECT id FROM firsts)
    """,
    "truncate_cascade": """
        SELECT 'customer' AS name, count(*) AS n, 'deleted' AS status, CAST(NULL AS INTEGER) AS next_id
        FROM customer
        UNION ALL SELECT 'orders', 0, 'deleted', 1
        UNION ALL SELECT 'lineitem', 0, 'deleted', 1
    """,
    "delete_cascade": """
        WITH gone AS (
          SELECT c_custkey AS id FROM customer
          WHERE c_custkey IN (SELECT c_custkey * 3 FROM customer)
        ),
        gone_orders AS (SELECT o_orderkey AS id FROM orders WHERE o_custkey IN (SELECT id FROM gone))
        SELECT 'customer' AS name, CASE WHEN c_custkey IN (SELECT id FROM gone)
                 THEN 'affected' ELSE 'after' END AS side,
               CAST(c_custkey AS BIGINT) AS key, CAST(0 AS BIGINT) AS line
        FROM customer
        UNION ALL
        SELECT 'orders', CASE WHEN o_orderkey IN (SELECT id FROM gone_orders)
                 THEN 'affected' ELSE 'after' END, o_orderkey, 0
        FROM orders
        UNION ALL
        SELECT 'lineitem', CASE WHEN l_orderkey IN (SELECT id FROM gone_orders)
                 THEN 'affected' ELSE 'after' END, l_orderkey, l_linenumber
        FROM lineitem
        UNION ALL
        SELECT 'request', CASE WHEN c_custkey * 3 IN (SELECT id FROM gone)
                 THEN 'deleted' ELSE 'not_found' END, c_custkey, 0
        FROM customer
    """,
    "delete_cascade_cycle": """
        WITH RECURSIVE nodes AS (
          SELECT 'part' AS name, CAST(p_partkey AS BIGINT) AS id,
                 CASE WHEN p_partkey % 3 = 0 THEN p_partkey // 2 WHEN p_partkey % 50 = 1 THEN p_partkey END AS part,
                 CASE WHEN p_partkey % 5 = 0 THEN p_partkey % (SELECT count(*) FROM supplier) END AS supplier
          FROM part
          UNION ALL
          SELECT 'supplier', s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey * 7 END, NULL FROM supplier
        ),
        gone AS (
          SELECT name, id FROM nodes WHERE name = 'part' AND id % 40 = 1
          UNION
          SELECT n.name, n.id FROM nodes n JOIN gone g
            ON (g.name = 'part' AND n.part = g.id) OR (g.name = 'supplier' AND n.supplier = g.id)
        )
        SELECT n.name, CASE WHEN g.id IS NULL THEN 'after' ELSE 'affected' END AS side, n.id
        FROM nodes n LEFT JOIN gone g ON g.name = n.name AND g.id = n.id
    """,
    "delete_restricted": """
        WITH requests AS (SELECT event_id AS request_id, event_id * 3 // 2 AS id FROM events),
        firsts AS (
          SELECT id, min(request_id) AS request_id FROM requests
          WHERE id IN (SELECT o_orderkey FROM orders) AND id NOT IN (SELECT l_orderkey FROM lineitem)
          GROUP BY id
        )
        SELECT 'request' AS kind, request_id AS id,
               CASE WHEN id NOT IN (SELECT o_orderkey FROM orders) THEN 'not_found'
                    WHEN id IN (SELECT l_orderkey FROM lineitem) THEN 'refused'
                    WHEN request_id IN (SELECT request_id FROM firsts) THEN 'deleted'
                    ELSE 'not_found' END AS status
        FROM requests
        UNION ALL
        SELECT 'kept', o_orderkey, '' FROM orders WHERE o_orderkey NOT IN (SELECT id FROM firsts)
    """,
    "insert_unique": """
        WITH staged AS (
          SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN ''
                 ELSE 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') END AS nip
          FROM orders
        ),
        judged AS (
          SELECT *, CASE WHEN nip = '' THEN 'missing'
                         WHEN nip IN (
                           SELECT 'Customer#' || lpad(CAST(c_custkey * 2 AS VARCHAR), 9, '0') FROM customer) THEN 'known'
                         WHEN o_orderkey > min(o_orderkey) OVER (PARTITION BY nip) THEN 'repeated'
                         ELSE '' END AS reason
          FROM staged
        )
        SELECT o_orderkey, nip, reason, CAST(NULL AS BIGINT) AS id FROM judged WHERE reason <> ''
        UNION ALL
        SELECT o_orderkey, nip, reason,
               (SELECT max(c_custkey) * 2 FROM customer)
                 + row_number() OVER (ORDER BY o_orderkey)
        FROM judged WHERE reason = ''
    """,
    "insert_defaults": """
        SELECT p_partkey AS id, p_name AS nama, p_brand AS peran FROM part
        UNION ALL
        SELECT o_orderkey, o_orderpriority,
               CASE WHEN o_orderstatus = 'O' THEN 'O' ELSE 'peserta' END
        FROM orders
    """,
    "update_by_key": """
        WITH changes AS (
          SELECT o_custkey * 2 AS id, o_orderkey AS seq, o_orderpriority AS role,
                 o_orderstatus = 'O' AS given
          FROM orders
        ),
        final AS (
          SELECT DISTINCT ON (id) id, role FROM changes WHERE given ORDER BY id, seq DESC
        )
        SELECT c_custkey AS id, coalesce(f.role, c_mktsegment) AS role,
               CASE WHEN f.id IS NULL THEN '2024-01-01' ELSE '2024-06-01' END AS updated_at
        FROM customer LEFT JOIN final f ON c_custkey = f.id
        UNION ALL
        SELECT -count(*), CASE WHEN id NOT IN (SELECT c_custkey FROM customer) THEN 'not_found'
                               WHEN given THEN 'updated' ELSE 'unchanged' END AS role, 'status'
        FROM changes GROUP BY 2
    """,
    "rename_unique": """
        WITH RECURSIVE requests AS (
          SELECT o_orderkey AS seq, o_custkey // 10 AS block,
                 CASE WHEN o_orderkey % 13 = 0 THEN -o_custkey ELSE o_custkey END AS id,
                 CASE WHEN o_orderkey % 11 = 0 THEN ''
                      WHEN o_orderkey % 3 = 0 THEN 'Customer#' || lpad(CAST(o_custkey // 10 * 10 + o_orderkey % 7 AS VARCHAR), 9, '0')
                      ELSE 'Tim ' || CAST(o_custkey // 10 AS VARCHAR) || ' ' || CAST(o_orderkey % 40 AS VARCHAR) END AS nama_tim,
                 row_number() OVER (PARTITION BY o_custkey // 10 ORDER BY o_orderkey) AS turn
          FROM orders
        ),
        teams AS (SELECT c_custkey AS id, c_name AS nama_tim, c_custkey // 10 AS block FROM customer),
        held(block, turn, ids, names, seq, id, nama_tim, status) AS (
          SELECT block, 0, list(id ORDER BY id), list(nama_tim ORDER BY id), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), '', ''
          FROM teams GROUP BY block
          UNION ALL
          SELECT block, turn, ids,
                 CASE WHEN status = 'updated' THEN list_transform(names, lambda n, i: CASE WHEN ids[i] = id THEN nama_tim ELSE n END) ELSE names END,
                 seq, id, nama_tim, status
          FROM (
            SELECT h.block, r.turn, h.ids, h.names, r.seq, r.id, r.nama_tim,
                   CASE WHEN r.nama_tim = '' THEN 'missing'
                        WHEN NOT list_contains(h.ids, r.id) THEN 'not_found'
                        WHEN list_contains(h.names, r.nama_tim) AND h.ids[list_position(h.names, r.nama_tim)] <> r.id THEN 'duplicate'
                        ELSE 'updated' END AS status
            FROM held h JOIN requests r ON r.block = h.block AND r.turn = h.turn + 1
          )
        ),
        last AS (SELECT block, unnest(ids) AS id, unnest(names) AS nama_tim FROM (
          SELECT DISTINCT ON (block) block, ids, names FROM held ORDER BY block, turn DESC))
        SELECT seq, id, nama_tim, status FROM held WHERE turn > 0
        UNION ALL
        SELECT NULL, id, nama_tim, 'after' FROM last
    """,
    "create_users": """
        WITH requests AS (
          SELECT p_partkey AS request_id, p_name AS nama, p_size,
                 'Supplier#' || lpad(CAST(p_partkey // 3 AS VARCHAR), 9, '0') AS nip
          FROM part
        ),
        judged AS (
          SELECT *, CASE WHEN p_size = 7 THEN 'role: not allowed'
                         WHEN nip IN (SELECT s_name FROM supplier) THEN 'known'
                         WHEN request_id > min(request_id) FILTER (WHERE p_size <> 7)
                                             OVER (PARTITION BY nip) THEN 'repeated'
                         ELSE '' END AS reason
          FROM requests
        ),
        made AS (
          SELECT *, (SELECT max(s_suppkey) FROM supplier)
                      + row_number() OVER (ORDER BY request_id) AS id
          FROM judged WHERE reason = ''
        )
        SELECT id, nip, nama, 'user' AS role, '' AS reason FROM made
        UNION ALL
        SELECT id, CAST(request_id AS VARCHAR), 'link', '', '' FROM made
        UNION ALL
        SELECT request_id, '', 'refused', '', reason FROM judged WHERE reason <> ''
    """,
    "update_users": f"""
        WITH {_ACCESS},
        requests AS (
          SELECT c_custkey AS request_id, c_custkey // 4 AS id,
                 CASE c_nationkey % 5 WHEN 0 THEN 'boss' WHEN 1 THEN '' WHEN 2 THEN 'admin' END AS role,
                 c_nationkey % 3 AS form
          FROM customer
        ),
        judged AS (
          SELECT *, concat_ws('; ', CASE WHEN role = 'boss' THEN 'role: not allowed' END,
                                    CASE WHEN form = 0 THEN 'ids: repeated' END) AS errors
          FROM requests
        ),
        final AS (
          SELECT id, max(request_id) FILTER (WHERE role = 'admin') AS admin_by,
                 max(request_id) FILTER (WHERE form = 1) AS set_by
          FROM judged WHERE errors = '' AND id IN (SELECT id FROM users) GROUP BY id
        )
        SELECT 'user' AS kind, u.id, CASE WHEN admin_by IS NULL THEN 'user' ELSE 'admin' END AS text,
               CASE WHEN admin_by IS NOT NULL THEN '2024-06-01' END AS more
        FROM users u LEFT JOIN final f ON u.id = f.id
        UNION ALL
        SELECT 'request', request_id,
               CASE WHEN errors <> '' THEN errors
                    WHEN id NOT IN (SELECT id FROM users) THEN 'not_found'
                    WHEN role = 'admin' THEN 'updated' ELSE 'unchanged' END, ''
        FROM judged
        UNION ALL
        SELECT 'link', user_id, CAST(permission_id AS VARCHAR), '' FROM links
        WHERE user_id NOT IN (SELECT id FROM final WHERE set_by IS NOT NULL)
        UNION ALL
        SELECT 'link', id, CAST(set_by + step AS VARCHAR), ''
        FROM final, (VALUES (0), (1)) AS steps (step) WHERE set_by IS NOT NULL
    """,
    "search_candidates": """
        WITH hits AS (
          SELECT p_partkey AS no_ukg, p_size AS tahun, p_name AS nama_lengkap FROM part
          WHERE p_name ILIKE '%ring%'
        )
        SELECT *, (SELECT count(*) FROM hits) AS total,
               (SELECT CAST(ceil(count(*) / 10.0) AS BIGINT) FROM hits) AS pages
        FROM hits ORDER BY nama_lengkap NULLS LAST, no_ukg, tahun LIMIT 10 OFFSET 10
    """,
    "single_value": """
        SELECT 'v0' AS isi
        UNION ALL SELECT '-'
    """,
    "update_all": "SELECT doc_id, lang, 'isi' AS text FROM documents",
    "validate_good": f"{_FAULTS} SELECT * EXCLUDE (errors) FROM judged WHERE errors = ''",
    "validate_bad": f"{_FAULTS} SELECT id, users_id, errors FROM judged WHERE errors <> ''",
    "split_manifest": f"""
        WITH numbered AS (
          SELECT l_orderkey, row_number() OVER (ORDER BY {_LINE_ORDER}) - 1 AS n FROM lineitem
        )
        SELECT CAST(n // 1000 + 1 AS BIGINT) AS part, count(*) AS n,
               'lines_part' || CAST(n // 1000 + 1 AS VARCHAR) || '.csv' AS name,
               min(l_orderkey) AS first_key, max(l_orderkey) AS last_key
        FROM (SELECT l_orderkey, n FROM numbered) GROUP BY n // 1000
    """,
    "split_rows": """
        WITH numbered AS (
          SELECT doc_id, lang, row_number() OVER (ORDER BY lang DESC NULLS FIRST, doc_id) - 1 AS n
          FROM documents
        )
        SELECT doc_id, lang, CAST(n // 64 + 1 AS BIGINT) AS part, CAST(n % 64 + 1 AS BIGINT) AS row_in_part
        FROM numbered
    """,
    "split_files": """
        SELECT p_partkey, p_name,
               'parts_part' || CAST((row_number() OVER (ORDER BY p_partkey) - 1) // 300 + 1 AS VARCHAR)
                 || '.csv' AS name
        FROM part
    """,
    "split_source": """
        WITH numbered AS (
          SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders
        )
        SELECT o_orderkey, o_custkey, CAST(n // 1000 + 1 AS BIGINT) AS part,
               CAST(n % 1000 + 1 AS BIGINT) AS row_in_part
        FROM numbered
    """,
    "split_source_lines": """
        WITH numbered AS (
          SELECT CAST(c_custkey AS VARCHAR) AS c_custkey,
                 'a "b", ' || c_mktsegment || chr(10) || CAST(c_nationkey AS VARCHAR) AS nick,
                 row_number() OVER (ORDER BY c_custkey) - 1 AS n
          FROM customer
        )
        SELECT c_custkey, nick, CAST(n // 100 + 1 AS BIGINT) AS part,
               CAST(n % 100 + 1 AS BIGINT) AS row_in_part, read
        FROM numbered, (VALUES ('whole'), ('pieces')) v(read)
    """,
    "load_participants": """
        SELECT CAST(s_suppkey * 2 AS BIGINT) AS peserta_id, 3 AS kegiatan_id, s_name AS nama,
               '' AS instansi
        FROM supplier
        UNION ALL
        SELECT (SELECT max(s_suppkey) * 2 FROM supplier) + row_number() OVER (ORDER BY p_partkey),
               9, p_name, p_brand
        FROM part
    """,
    "load_activities": """
        SELECT CAST(c_custkey + 5 AS BIGINT) AS id, CAST(NULL AS BIGINT) AS users_id,
               CAST(NULL AS VARCHAR) AS nama_kegiatan, CAST(NULL AS DATE) AS tanggal_mulai,
               CAST(NULL AS INTEGER) AS total_peserta
        FROM customer
        UNION ALL
        SELECT (SELECT max(c_custkey) + 5 FROM customer) + row_number() OVER (ORDER BY o_orderkey),
               4, o_orderpriority, CAST(o_orderdate AS DATE), CAST(o_orderkey AS INTEGER)
        FROM orders
    """,
    "page_500": """
        SELECT * REPLACE (CAST(o_orderdate AS DATE) AS o_orderdate) FROM orders
        ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey LIMIT 10 OFFSET 490
    """,
    "page_5000": f"""
        SELECT * REPLACE (CAST(l_shipdate AS DATE) AS l_shipdate) FROM lineitem
        ORDER BY {_PAGE_ORDER} LIMIT 10 OFFSET 4990
    """,
    "page_far": f"""
        SELECT * REPLACE (CAST(l_shipdate AS DATE) AS l_shipdate) FROM lineitem
        ORDER BY {_PAGE_ORDER} LIMIT 100 OFFSET 24900
    """,
    "rank_hot_groups": """
        SELECT l_returnflag, l_orderkey, l_linenumber,
               row_number() OVER (
                 PARTITION BY l_returnflag ORDER BY l_orderkey DESC, l_linenumber) AS rank
        FROM lineitem
    """,
    "clear_tables": """
        WITH held(name, n) AS (
          SELECT 'ptk', count(*) FROM orders UNION ALL SELECT 'data_sekolah', count(*) FROM customer
          UNION ALL SELECT 'ppg', 0 UNION ALL SELECT 'kegiatan', count(*) FROM supplier
          UNION ALL SELECT 'peserta', count(*) FROM lineitem
        ),
        emptied(clear, name) AS (
          VALUES ('staff', 'ptk'), ('schools', 'data_sekolah'), ('schools', 'ptk'),
                 ('activities', 'kegiatan'), ('activities', 'peserta')
        ),
        clears(clear, status) AS (
          VALUES ('staff', 'deleted'), ('schools', 'deleted'), ('candidates', 'already_empty'),
                 ('activities', 'deleted')
        )
        SELECT h.name, CASE WHEN e.name IS NULL THEN h.n ELSE 0 END AS n, c.clear, c.status
        FROM held h CROSS JOIN clears c LEFT JOIN emptied e ON e.clear = c.clear AND e.name = h.name
    """,
}
