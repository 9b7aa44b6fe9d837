"""DuckDB SQL for the queries of this package that SQL can express."""

from tandem.llm import licenses

ORACLES: dict[str, str] = {}

ORACLES["op3_exact_dedup"] = r"""
WITH texts AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM texts WINDOW w AS (PARTITION BY t)
"""

ORACLES["op1_near_dedup"] = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM split
), flat AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, min(r.b)) AS component_id,
       s.doc_id = least(s.doc_id, min(r.b)) AS kept
FROM sets s LEFT JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.s
"""

_SKETCH = """list_sort(list_distinct(list_concat(list_filter({0}, lambda h: h < '2000000000000000'),
    CASE WHEN len({0}) > 0 THEN [list_min({0})] ELSE [] END)))"""
_HASHES = r"""CASE WHEN len({0}) = 0 THEN []::VARCHAR[] WHEN len({0}) < 5 THEN [substr(md5(array_to_string({0}, ' ')), 1, 16)]
    ELSE list_transform(range(1, len({0}) - 3), lambda i: substr(md5(array_to_string({0}[i:i + 4], ' ')), 1, 16)) END"""
_WORDS = r"list_filter(string_split_regex({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_ALIKE = """CASE WHEN len({0}) = 0 AND len({1}) = 0 THEN 1.0 WHEN least(len({0}), len({1})) = 0 THEN 0.0
    ELSE len(list_intersect({0}, {1}))::DOUBLE / least(len({0}), len({1})) END"""

ORACLES["op2_fingerprints"] = f"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), next AS (
  SELECT doc_id, t, length(t) AS n,
         coalesce(lead(t) OVER (ORDER BY doc_id), first(t) OVER (ORDER BY doc_id)) AS u FROM texts
), edits AS (
  SELECT *, substr(t, 1, n - n // 4) || substr(u, 1, n // 4) AS e FROM next
), words AS (
  SELECT *, {_WORDS.format("t")} AS tw, {_WORDS.format("e")} AS ew, {_WORDS.format("u")} AS uw FROM edits
), hashes AS (
  SELECT *, {_HASHES.format("tw")} AS th, {_HASHES.format("ew")} AS eh, {_HASHES.format("uw")} AS uh FROM words
), kept AS (
  SELECT *, {_SKETCH.format("th")} AS tk, {_SKETCH.format("eh")} AS ek, {_SKETCH.format("uh")} AS uk FROM hashes
)
SELECT doc_id, n::BIGINT AS n_chars, sha256(e) AS edited_sha256,
       array_to_string(tk, '') AS fingerprint, array_to_string(ek, '') AS edited_fingerprint,
       ({_ALIKE.format("tk", "ek")})::DOUBLE AS near_edited, ({_ALIKE.format("tk", "uk")})::DOUBLE AS near_next
FROM kept
"""


def _license_sql() -> str:
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    known = "[" + ", ".join(map(quoted, licenses.KNOWN)) + "]"
    low = f"translate({{0}}, '{licenses.UPPER}', '{licenses.LOWER}')"
    ends = "regexp_replace(t, '[.!?;:]([\\x20\\x09-\\x0D]|\\z)', chr(1), 'g')"

    def cut(marked: str) -> str:
        clean = f"regexp_replace({low.format(marked)}, '[^a-z0-9\\x01]+', ' ', 'g')"
        own = f"list_filter(list_transform(string_split({clean}, chr(1)), lambda s: trim(s, ' ')), lambda s: s <> '')"
        return f"list_transform({own}, lambda s: coalesce(list_position({known}, s), 0))"

    rules = ", ".join(
        f"CASE WHEN contains(lr, '{licenses.rule_text(names)}') OR contains(fr, '{licenses.rule_text(names)}')"
        f" THEN '{license_}' END"
        for license_, names in licenses.RULES
    )
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
cut AS (SELECT doc_id, {cut(f"translate({ends}, chr(10), chr(1))")} AS l, {cut(ends)} AS f FROM texts),
runs AS (
  SELECT *, ',' || array_to_string(l, ',') || ',' AS lr, ',' || array_to_string(f, ',') || ',' AS fr FROM cut
), found AS (
  SELECT *, list_sort(list_distinct(list_filter([{rules}], lambda x: x IS NOT NULL))) AS names FROM runs
)
SELECT doc_id, len(l)::BIGINT AS n_sentences, len(list_filter(l, lambda n: n > 0))::BIGINT AS n_known,
       coalesce(array_to_string(list_filter(l, lambda n: n > 0), ','), '') AS sentences,
       coalesce(array_to_string(list_filter(names,
         lambda x: NOT (x = 'BSD-2-Clause' AND list_contains(names, 'BSD-3-Clause'))), ','), '') AS licenses
FROM found
"""


ORACLES["op6_license_scan"] = _license_sql()

ORACLES["op9_repeated_passages"] = r"""
WITH split AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, unnest(list_transform(range(1, len(w) - 11),
    lambda i: array_to_string(w[i:i + 12], ' '))) AS p FROM split
), least AS (
  SELECT p, min(doc_id) AS m FROM windows GROUP BY p
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM windows JOIN least USING (p) WHERE doc_id > m
), words AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM split
), kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n
  FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT s.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON s.doc_id = k.doc_id
"""

ORACLES["op11_source_divergence"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS n, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
words AS (SELECT n, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT n) >= 3),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY ALL),
size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c
  FROM groups g JOIN kept k ON k.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shared AS (
  SELECT lang, source, term, c,
    1 + (1000000000::HUGEINT * (c + 1)) // (sum(c) OVER (PARTITION BY lang, source) + v)::HUGEINT AS p
  FROM cells JOIN size USING (lang)),
langs AS (SELECT lang, term, sum(c) AS c FROM cells GROUP BY lang, term),
whole AS (
  SELECT lang, term,
    1 + (1000000000::HUGEINT * (c + 1)) // (sum(c) OVER (PARTITION BY lang) + v)::HUGEINT AS q
  FROM langs JOIN size USING (lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM shared a JOIN shared b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q
  FROM shared JOIN whole USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM found)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM ranked WHERE part = 'pair' OR rank <= 200
"""

ORACLES["op12_periodic_runs"] = r"""
WITH RECURSIVE steps(i, k, c) AS (
  SELECT i, 0, i::UBIGINT FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END FROM steps WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8
), split AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    xor(list_reduce([4294967295::UBIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::UBIGINT),
      lambda a, b: xor(a // 256, t[(xor(a, b) % 256 + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT AS h
  FROM documents, crc
), places AS (
  SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a FROM split
), periods AS (
  SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM places
), edited AS (
  SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(0, n), lambda i: w[(1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END)::BIGINT]) ELSE w END AS w
  FROM periods
), words AS (
  SELECT r, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM edited WHERE n >= 24
), diagonals AS (
  SELECT b.r, b.i - a.i AS q, b.i AS i FROM words a JOIN words b ON a.r = b.r AND a.word = b.word AND a.i < b.i AND 3 * (b.i - a.i) <= b.n
), stretches AS (
  SELECT r, q, min(i) - q AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM diagonals) GROUP BY r, q, island
), runs AS (
  SELECT r, start, length, min(q) AS period FROM stretches WHERE length >= greatest(24, 3 * q) GROUP BY r, start, length
), listed AS (
  SELECT r, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS shown,
    list({'s': start, 'l': length, 'p': period} ORDER BY start, period) AS all_runs,
    list_distinct(flatten(list(range(start + period, start + length)))) AS dropped
  FROM runs GROUP BY r
), best AS (
  SELECT DISTINCT ON (a.r) a.r, a.start, a.length, a.period FROM runs a
  WHERE NOT EXISTS (SELECT 1 FROM runs b WHERE b.r = a.r AND b.length * a.period > a.length * b.period)
  ORDER BY a.r, a.start, a.period
), kept AS (
  SELECT e.r, array_to_string(CASE WHEN l.r IS NULL THEN e.w ELSE list_transform(
    list_filter(range(0, e.n), lambda i: NOT list_contains(l.dropped, i)), lambda i: e.w[i + 1]) END, ' ') AS text
  FROM edited e LEFT JOIN listed l USING (r)
)
SELECT e.doc_id, coalesce(l.n_runs, 0)::BIGINT AS n_runs, b.start::BIGINT AS start, b.length::BIGINT AS length, b.period::BIGINT AS period,
  (1000 * b.length // b.period)::BIGINT AS exponent_milli, sha256(coalesce(l.shown, '')) AS runs_sha256, sha256(k.text) AS collapsed_sha256
FROM edited e JOIN kept k USING (r) LEFT JOIN listed l USING (r) LEFT JOIN best b USING (r)
"""

ORACLES["op13_jaccard_join"] = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s
  FROM split
), flat AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, min(r.b)) AS component_id
FROM sets s LEFT JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.s
"""
