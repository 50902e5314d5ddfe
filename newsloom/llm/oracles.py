"""The queries that SQL can express, as DuckDB SQL over the given tables."""

from __future__ import annotations

from newsloom.llm.licenses import NOTICES, PHRASES


def _merkle(source_levels: int = 6, root_levels: int = 4) -> str:
    """The manifest with the levels written out; a tree lower than that passes its root through."""

    def field(name: str) -> str:
        return f"coalesce(strlen(CAST({name} AS VARCHAR)) || ':' || {name}, '-')"

    fields = " || ".join(field(n) for n in ("doc_id", "source", "lang", "n_chars"))
    # crc32 bit by bit: a byte is put in, then eight shifts
    crc = """xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
        lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295)"""
    ctes = [f"""d AS (
            SELECT *, coalesce('=' || source, '') AS tree, sha256({fields} || {field("text")}) AS leaf,
                CASE WHEN {crc} % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS later
            FROM documents
        )""", f"""w0 AS (
            SELECT doc_id, leaf, tree, sha256({fields} || {field("later")}) AS folded, '' AS proof,
                row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY tree) AS c FROM d
        )""", "n0 AS (SELECT tree, p, leaf AS h, c FROM w0)"]
    for k in range(source_levels + root_levels):
        if k == source_levels:
            ctes.append(f"""r{k} AS (
            SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS p, h, count(*) OVER () AS c, tree AS of FROM n{k}
        ), v{k} AS (
            SELECT doc_id, leaf, w.h AS subroot, '' AS tree, folded, proof, r.p FROM (SELECT w{k}.*, n{k}.h FROM w{k} JOIN n{k} USING (tree)) w
            JOIN r{k} r ON r.of = w.tree
        )""")
        w, n = (f"v{k}", f"r{k}") if k == source_levels else (f"w{k}", f"n{k}")
        subroot = ", subroot" if k >= source_levels else ""
        ctes.append(f"""g{k} AS (
            SELECT tree, p // 16 AS p, list(h ORDER BY p) AS hs, any_value(c) AS c FROM {n} GROUP BY tree, p // 16
        ), n{k + 1} AS (
            SELECT tree, p, CASE WHEN c > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h, (c + 15) // 16 AS c FROM g{k}
        ), w{k + 1} AS (
            SELECT doc_id, leaf{subroot}, tree, CASE WHEN c > 1 THEN sha256(lefts || folded || rights) ELSE folded END AS folded,
                CASE WHEN c > 1 THEN proof || lefts || rights ELSE proof END AS proof, p FROM (
                SELECT w.* EXCLUDE (p), g.p, g.c, array_to_string(g.hs[1:w.p % 16], '') AS lefts, array_to_string(g.hs[w.p % 16 + 2:], '') AS rights
                FROM (SELECT * {"EXCLUDE (c) " if k == 0 else ""}FROM {w}) w JOIN g{k} g ON g.tree = w.tree AND g.p = w.p // 16)
        )""")
    last = source_levels + root_levels
    return f"""
        WITH {", ".join(ctes)}
        SELECT doc_id, leaf, subroot, n.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = n.h AS verified
        FROM w{last} JOIN n{last} n USING (tree)
    """


def _license_scan() -> str:
    """Every span of whole words as long as a notice, give or take its edits. No notice has a ``~``, so it never agrees."""
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES)
    notices = ", ".join(f"('{n.text}', '{n.label}', {n.edits})" for n in NOTICES)
    most = max(len(n.text.split()) + n.edits for n in NOTICES)
    return rf"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), phrases(phrase, label, m) AS (VALUES {phrases}
        ), notices(notice, label, edits) AS (VALUES {notices}
        ), words AS (
            SELECT doc_id, generate_subscripts(w, 1) AS p, unnest(w) AS word FROM d
        ), starts AS (
            SELECT doc_id, p, list(word) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND {most - 1} FOLLOWING) AS w
            FROM words
        ), base AS (
            SELECT doc_id, count(*) AS n, min(p) - 1 AS first_word, max(p) - 1 AS last_word, list(label) AS labels
            FROM starts JOIN phrases ON array_to_string(w[1:m], ' ') = phrase GROUP BY doc_id
        ), spans AS (
            SELECT doc_id, regexp_replace(array_to_string(w[1:m], ' '), '[^\x00-\x7F]', '~', 'g') AS span
            FROM starts, range(1, {most + 1}) r(m) WHERE m <= len(w) AND length(array_to_string(w[1:m], ' '))
                BETWEEN (SELECT min(length(notice) - edits) FROM notices) AND (SELECT max(length(notice) + edits) FROM notices)
        ), near AS (
            SELECT doc_id, label, (length(notice) - levenshtein(span, notice)) / length(notice) AS share
            FROM spans JOIN notices ON abs(length(span) - length(notice)) <= edits WHERE levenshtein(span, notice) <= edits
        ), fuzzy AS (
            SELECT doc_id, list(label) AS labels, max(share) AS score FROM near GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(b.n, 0) AS n_base, b.first_word, b.last_word,
            coalesce(array_to_string(list_sort(list_distinct(b.labels)), ','), '') AS base_labels,
            coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ','), '') AS labels,
            CAST(CASE WHEN b.n > 0 THEN 1 ELSE coalesce(f.score, 0) END AS DOUBLE) AS score
        FROM d LEFT JOIN base b ON b.doc_id = d.doc_id LEFT JOIN fuzzy f ON f.doc_id = d.doc_id
    """


ORACLES: dict[str, str] = {
    "op1_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
        ), windows AS (
            SELECT doc_id, words, unnest(generate_series(1, len(words) - 19)) AS start FROM d WHERE len(words) >= 20
        ), keyed AS (
            SELECT doc_id, start, array_to_string(words[start:start + 19], ' ') AS content FROM windows
        ), ranked AS (
            SELECT doc_id, start, row_number() OVER (PARTITION BY content ORDER BY doc_id, start) AS nth FROM keyed
        ), covered AS (
            SELECT DISTINCT doc_id, unnest(generate_series(start, start + 19)) AS place FROM ranked WHERE nth > 1
        ), gone AS (
            SELECT doc_id, list(place) AS places FROM covered GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
            sha256(CASE WHEN places IS NULL THEN array_to_string(words, ' ') ELSE
                coalesce(array_to_string(list_filter(words, lambda w, i: NOT list_contains(places, i)), ' '), '')
            END) AS kept_sha256
        FROM d LEFT JOIN gone ON d.doc_id = gone.doc_id
    """,
    "op9_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents
        )
        SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
            doc_id = min(doc_id) OVER same AS kept, text_sha256
        FROM n WINDOW same AS (PARTITION BY text_sha256)
    """,
    "op2_embedding_near_dedup": r"""
        WITH RECURSIVE v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), u AS (
            SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS norm FROM v WHERE list_inner_product(e, e) > 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id
            WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.9
        ), reach(vec_id, other) AS (
            SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other
        ), n AS (
            SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a
        )
        SELECT r.vec_id, CAST(coalesce(any_value(n.n_links), 0) AS BIGINT) AS n_links, min(other) AS component_id,
            r.vec_id = min(other) AS kept
        FROM reach r LEFT JOIN n ON n.vec_id = r.vec_id GROUP BY r.vec_id
    """,
    "op5_lm_scores": r"""
        WITH d AS (
            SELECT doc_id, ['', ''] || regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), g AS (
            SELECT doc_id, w[p] || ' ' || w[p + 1] AS context, w[p + 2] AS word
            FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS p FROM d)
        ), c AS (
            SELECT doc_id, ln(count(*) OVER (PARTITION BY context, word)) - ln(count(*) OVER (PARTITION BY context)) AS score FROM g
        ), s AS (
            SELECT doc_id, round(sum(score), 6) AS log_score FROM c GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(len(w) - 2 AS BIGINT) AS n_words, log_score FROM d LEFT JOIN s ON s.doc_id = d.doc_id
    """,
    "op8_ngram_jaccard_join": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS shingle
            FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS p FROM d WHERE len(w) > 0)
        ), n AS (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), shared AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
            GROUP BY x.doc_id, y.doc_id
        ), links AS (
            SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)
        ), reach(doc_id, other) AS (
            SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
        )
        SELECT r.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(other) AS component_id
        FROM reach r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
    """,
    "op10_warc": r"""
        WITH p AS (
            SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
        ), h AS (
            SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS hex, max(page_id) OVER (PARTITION BY body) AS latest FROM p
        ), groups AS (
            SELECT *, list_transform(range(8), lambda g: list_sum(list_transform(range(5), lambda i:
                (instr('0123456789abcdef', substring(hex, CAST(5 * g + i + 1 AS BIGINT), 1)) - 1) << CAST(16 - 4 * i AS BIGINT)))) AS twenty FROM h
        )
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
            array_to_string(list_transform(twenty, lambda t: array_to_string(list_transform([15, 10, 5, 0], lambda b:
                substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST(t AS BIGINT) >> b) & 31) + 1 AS BIGINT), 1)), '')), '') AS payload_digest,
            CASE WHEN page_id < latest THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN page_id < latest THEN latest END AS refers_to
        FROM groups
    """,
    "op11_merkle_manifest": _merkle(),
    "op12_hard_negatives": r"""
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
        ), p AS (
            SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
            n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
        FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
        QUALIFY rank <= 5
    """,
    "op13_license_scan": _license_scan(),
}
