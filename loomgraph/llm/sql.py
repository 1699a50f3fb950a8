"""SQL of the corpus queries for DuckDB, where SQL can express them over whole tables."""

from __future__ import annotations

#: Patterns of the secret scan for RE2: either case is written out, since its own flag folds beyond ASCII.
_either = lambda words: "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in words.split("|"))
_QUOTES = "[\"'']?\x20*[:=]\x20*[\"'']?"
_KINDS = {
    "assign": f"({_either('password|passwd|secret|token')}|{_either('api')}_?{_either('key')}){_QUOTES}([A-Za-z0-9+/_.=-]+)", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]{16,}",
    "ident": f"({_either('user|username|login|account')}|{_either('client')}_?{_either('id')}){_QUOTES}([A-Za-z0-9@_.-]{{4,}})", "blob": "[A-Za-z0-9+/]{40,}",
    "endpoint": "(https?|ftps?|ssh|jdbc|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D\"''<>]+",
}
_cases = lambda: "[" + ", ".join(f"'{k}'" for k in _KINDS) + "][k + 1]"
_MATCHES = " UNION ALL ".join(f"SELECT r, {k} AS k, regexp_extract_all(t, '{p}') AS h, string_split_regex(t, '{p}') AS g FROM d" for k, p in enumerate(_KINDS.values()))

ORACLES = {
    # Base32 of a SHA-1: five hexadecimal digits are four letters.
    "op1_warc_writer": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), s AS (SELECT page_id, html, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS owner FROM p)
        SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
               CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> owner THEN owner END AS refers_to FROM s
    """,
    # All strings of 100 bytes as hexadecimal digits, by their MD5; doc_ids differ.
    "op7_run_length_index": """
        WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        s AS (SELECT r, i, md5_number(substr(x, 2 * i + 1, 200)) AS w FROM (SELECT r, x, unnest(range(0, length(x) // 2 - 99)) AS i FROM d)),
        f AS (SELECT r, i FROM (SELECT r, i, row_number() OVER (PARTITION BY w ORDER BY r, i) AS k FROM s) WHERE k > 1),
        g AS (SELECT r, i, CASE WHEN i - lag(i) OVER w <= 100 THEN 0 ELSE 1 END AS fresh FROM f WINDOW w AS (PARTITION BY r ORDER BY i)),
        u AS (SELECT r, n, min(i) AS a, max(i) + 100 AS z FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS n FROM g) GROUP BY r, n),
        v AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS y FROM u),
        k AS (SELECT d.r, any_value(doc_id) AS doc_id, any_value(x) AS x, count(a) AS n_spans, coalesce(sum(z - a), 0) AS n_removed, coalesce(max(z), 0) AS last, coalesce(string_agg(substr(x, (2 * y + 1)::BIGINT, (2 * (a - y))::BIGINT), '' ORDER BY a), '') AS kept FROM d LEFT JOIN v ON v.r = d.r GROUP BY d.r)
        SELECT doc_id, length(x) // 2 AS n_bytes, n_removed::BIGINT AS n_removed, n_spans, sha256(unhex(kept || substr(x, (2 * last + 1)::BIGINT))) AS kept_sha256 FROM k
    """,
    "op9_credential_linking": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), a AS ({_MATCHES}), m AS (SELECT r, k, h, g, unnest(range(len(h))) AS i FROM a WHERE len(h) > 0),
        p AS (SELECT r, k, h[i + 1] AS hit, list_sum(list_transform(g[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i], lambda x: length(x))), 0) AS s FROM m),
        q AS (SELECT r, k, s::BIGINT AS s, (s + length(hit))::BIGINT AS e, {_cases()} AS kind, CASE WHEN k IN (0, 2, 4) THEN 'secret' WHEN k IN (1, 3) THEN 'identifier' ELSE 'endpoint' END AS c FROM p
              WHERE CASE k WHEN 0 THEN length(regexp_extract(hit, '{_KINDS['assign']}', 2)) >= 12 WHEN 1 THEN length(hit) >= 18 WHEN 4 THEN regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[a-z]') AND regexp_matches(hit, '[A-Z]') ELSE true END),
        x AS (SELECT * FROM q WHERE k < 3 OR EXISTS (SELECT 1 FROM q o WHERE o.r = q.r AND o.s <= q.e + 200 AND o.e >= q.s - 200 AND (o.c = 'secret') <> (q.c = 'secret'))),
        y AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) FILTER (k < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) AS spans FROM x GROUP BY r)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN y USING (r)
    """,
    # A message's part is the weight (bytes and 16 KiB each) of those before it over 16 MiB.
    "op2_perspective_rotation": r"""
        WITH u AS (SELECT conv_id, turn, role, coalesce(text, '') AS t, count(*) AS copies FROM conversations GROUP BY ALL), w AS (SELECT *, octet_length(encode(t)) + 16384 AS w FROM u),
        m AS (SELECT conv_id, turn, role, t, copies, coalesce(role = 'system', false) AS aside, ((sum(w) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(t), role NULLS FIRST ROWS UNBOUNDED PRECEDING) - w) // 16777216)::BIGINT AS part FROM w),
        p AS (SELECT DISTINCT conv_id, role AS perspective FROM m WHERE NOT aside),
        v AS (SELECT m.*, perspective, NOT aside AND role IS NOT DISTINCT FROM perspective AS own, row_number() OVER (PARTITION BY m.conv_id, perspective, part ORDER BY turn NULLS FIRST, md5(t), role NULLS FIRST) AS i FROM m JOIN p ON m.conv_id IS NOT DISTINCT FROM p.conv_id),
        h AS (SELECT *, '<|im_start|>' || CASE WHEN aside THEN role WHEN own THEN 'assistant' ELSE 'user' || coalesce(' name=' || regexp_replace(role, '[\x00-\x1F\x7F]', ' ', 'g'), '') END || chr(10) AS head FROM v),
        c AS (SELECT *, head || t || '<|im_end|>' || chr(10) AS piece FROM h),
        s AS (SELECT *, (sum(length(piece)) OVER (PARTITION BY conv_id, perspective, part ORDER BY i))::BIGINT - 1 AS stop FROM c)
        SELECT conv_id, perspective, part, sum(copies)::BIGINT AS n_rows, count(*) AS n_messages, count(*) FILTER (own) AS n_trained, sum(length(piece))::BIGINT AS n_chars, sha256(string_agg(piece, '' ORDER BY i)) AS text_sha256,
               coalesce(string_agg((stop - length(t) - 10) || ':' || stop, ',' ORDER BY i) FILTER (own), '') AS mask
        FROM s GROUP BY conv_id, perspective, part
    """,
    "op3_patricia_exact_dedup": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d
    """,
    "op8_benchmark_decontamination": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        s AS (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
        windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS t FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM s)),
        pos AS (SELECT r, k, i, array_to_string(w[i : i + k - 1], ' ') AS t FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)),
        hits AS (SELECT r, pos.k, i, item_id FROM pos JOIN windows ON pos.t = windows.t AND pos.k = windows.k),
        covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r),
        items AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY r)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
    """,
    # CRC-32 step by step over the bytes: in DuckDB there is no function for it.
    "op6_stratified_interleave": """
        WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
        bits AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
        u AS (SELECT t, encode(t) AS raw FROM (SELECT DISTINCT t FROM d)),
        h AS (SELECT t, octet_length(raw) AS n, list_transform(range(0, 2 * octet_length(raw), 2), lambda i: (strpos('0123456789ABCDEF', substr(hex(raw), i + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(hex(raw), i + 2, 1)) - 1) AS b FROM u),
        c AS (SELECT t, n, xor(list_reduce(list_prepend(4294967295, b), lambda x, y: xor(x >> 8, tab[xor(x & 255, y) + 1])), 4294967295) AS crc FROM h, bits),
        k AS (SELECT d.*, n, crc, md5('42|' || coalesce(doc_id::VARCHAR, '') || '|' || crc::BIGINT) AS key FROM d JOIN c USING (t)),
        f AS (SELECT *, n + 16 AS size, crc AS text_crc32, (2 * row_number() OVER (PARTITION BY source ORDER BY key, doc_id, crc, n) - 1)::DOUBLE / (2 * count(*) OVER (PARTITION BY source)) AS share FROM k),
        o AS (SELECT * EXCLUDE (n), row_number() OVER (ORDER BY share, source NULLS FIRST, key, doc_id, text_crc32, size) - 1 AS pos, count(*) OVER () AS n FROM f),
        q AS (SELECT *, n // 40 AS q, n % 40 AS r FROM o)
        SELECT doc_id, size, text_crc32, 'rows' AS law, (CASE WHEN pos < r * (q + 1) THEN pos // (q + 1) ELSE r + (pos - r * (q + 1)) // greatest(q, 1) END)::INTEGER AS shard,
               (CASE WHEN pos < r * (q + 1) THEN pos % (q + 1) ELSE (pos - r * (q + 1)) % greatest(q, 1) END)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM q
    """,
    # Scores in integers; weights are floors of doubles.
    "op11_tput_search": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        i AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
        s AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS l FROM d),
        t AS (SELECT q, term, count(*) AS times FROM (SELECT q, unnest(w) AS term FROM i) GROUP BY q, term),
        p AS (SELECT r, n, term, count(*) AS tf FROM (SELECT r, len(w) AS n, unnest(w) AS term FROM d) SEMI JOIN t USING (term) GROUP BY r, n, term),
        f AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM p, s GROUP BY term),
        g AS (SELECT r, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * n_docs) // l)))) AS gain FROM p JOIN f USING (term), s),
        c AS (SELECT q, r, sum(times * gain)::BIGINT AS score FROM t JOIN g USING (term) GROUP BY q, r),
        k AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM c JOIN d USING (r) WHERE score > 0)
        SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k JOIN i USING (q) WHERE rank <= 10
    """,
    # CRC-32 is linear: that of a string is the XOR of what each byte gives, carried over the bytes that follow it (z).
    "op13_importance_resampling": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        i AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        u AS MATERIALIZED (SELECT row_number() OVER () AS id, w FROM (SELECT DISTINCT w FROM (SELECT w FROM d UNION ALL SELECT w FROM i))),
        pos AS (SELECT id, unnest(w) AS one, unnest(w[2:]) AS two, unnest(w[3:]) AS three FROM u),
        held AS MATERIALIZED (SELECT id, f, count(*) AS n FROM (SELECT id, unnest([one, one || ' ' || two, one || ' ' || two || ' ' || three]) AS f FROM pos) WHERE f IS NOT NULL GROUP BY id, f),
        raw AS MATERIALIZED (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM held)),
        tab AS MATERIALIZED (SELECT x, list_reduce(list_prepend(x, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS y FROM (SELECT unnest(range(256)) AS x)),
        one AS (SELECT x, xor(xor(16777215, y), 4294967295) AS v FROM (SELECT 255 - x AS x, y FROM tab)),
        steps(n, x, v) AS (SELECT 0::BIGINT, x, v FROM one UNION ALL SELECT n + 1, steps.x, xor(v >> 8, y) FROM steps JOIN tab ON tab.x = v & 255 WHERE n < (SELECT max(length(h)) // 2 FROM raw)),
        z AS MATERIALIZED (SELECT n, printf('%02X', x) AS x, v FROM steps),
        b AS (SELECT f, bit_xor(v) % 10000 AS bucket FROM (SELECT f, h, unnest(range(length(h) // 2)) AS k FROM raw) r JOIN z ON z.n = length(h) // 2 - 1 - k AND z.x = substr(h, 2 * k + 1, 2) GROUP BY f),
        v AS MATERIALIZED (SELECT id, bucket, sum(n)::BIGINT AS n FROM held JOIN b USING (f) GROUP BY id, bucket),
        e AS MATERIALIZED (SELECT doc_id, id, len(w) AS n_words FROM d JOIN u USING (w)), j AS (SELECT id FROM i JOIN u USING (w)),
        s AS (SELECT bucket, sum(n)::BIGINT AS s FROM e JOIN v USING (id) GROUP BY bucket), m AS (SELECT bucket, sum(n)::BIGINT AS t FROM j JOIN v USING (id) GROUP BY bucket),
        a AS (SELECT coalesce((SELECT sum(s) FROM s), 0)::DOUBLE AS sn, coalesce((SELECT sum(t) FROM m), 0)::DOUBLE AS tn),
        g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (sn + 10000) / ((s + 1.0::DOUBLE) * (tn + 10000))))::BIGINT AS gain FROM s LEFT JOIN m USING (bucket), a),
        ws AS (SELECT id, sum(n * gain)::BIGINT AS weight, sum(n)::BIGINT AS n_features FROM v JOIN g USING (bucket) GROUP BY id),
        o AS (SELECT doc_id, n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM e LEFT JOIN ws USING (id)),
        k AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM o)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * n // 100 THEN place END AS rank FROM k
    """,
}
