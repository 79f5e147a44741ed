"""DuckDB SQL of the queries that SQL can express."""

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Sets of three-word shingles, compared through the shingles that two
#: documents share; equal sets are one class, and classes are joined to
#: components by the smallest id that can be reached.
MINHASH = f"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
    FROM words),
sized AS (SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), chr(10))) AS class, s FROM sets),
classes AS (SELECT class, min(doc_id) AS id, min(n) AS n, arg_min(s, doc_id) AS s FROM sized WHERE n > 0 GROUP BY class),
grams AS (SELECT id, n, unnest(s) AS g FROM classes),
shared AS (
    SELECT a.id AS a, b.id AS b, count(*) AS common, any_value(a.n) AS na, any_value(b.n) AS nb
    FROM grams a JOIN grams b ON a.g = b.g AND a.id < b.id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 85
    GROUP BY a.id, b.id),
links AS (SELECT a, b FROM shared WHERE 100 * common >= 85 * (na + nb - common)),
reach(id, other) AS (
    SELECT id, id FROM classes
    UNION
    SELECT r.id, l.other FROM reach r JOIN (SELECT a, b AS other FROM links UNION ALL SELECT b, a FROM links) l ON l.a = r.other),
component AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, d.n AS n_shingles, coalesce(p.component_id, d.doc_id) AS component_id,
       d.doc_id = coalesce(p.component_id, d.doc_id) AS kept
FROM sized d LEFT JOIN classes c ON c.class = d.class AND d.n > 0 LEFT JOIN component p ON p.id = c.id
"""


def url_filter(rules: list[tuple[str, str, str]], listed_terms: str) -> str:
    """Rules, then the list of canonical URLs."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [(kind, at + prefix, f"(host = '{at}' OR ends_with(host, '.{at}')) AND starts_with(path, '{prefix}')") for kind, at, prefix in ordered]
    name = " ".join(f"WHEN {c} THEN '{n}'" for _, n, c in fits)
    verdict = " ".join(f"WHEN {c} THEN '{k}'" for k, _, c in fits)
    return f"""
WITH parts AS (
    SELECT page_id, {_FOLD.format("coalesce(regexp_extract(url, '://([^/?#]*)', 1), '')")} AS host,
           coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages),
named AS (
    SELECT *, CASE WHEN host <> '' THEN
        regexp_replace(regexp_replace(host, ':[0-9]*$', ''), '^(?:www|m)\\.([^.]+\\.)', '\\1')
        || regexp_replace(regexp_replace(path, '(/index)?\\.(html?|php)$', ''), '/+$', '') END AS canonical
    FROM parts),
judged AS (
    SELECT *, coalesce(canonical IN (SELECT canonical FROM named WHERE regexp_matches(host, '{listed_terms}') AND canonical IS NOT NULL), false) AS listed
    FROM named)
SELECT page_id, host, path, CASE {name} END AS rule, CASE {verdict} WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM judged
"""


#: Cuts by code points; the text is rebuilt from the output's markers.
FIM = """
WITH drawn AS (
    SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
numbers AS (
    SELECT doc_id, t, length(t)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
           ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
    FROM drawn),
cuts AS (
    SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
           CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM numbers),
parts AS (
    SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM cuts),
made AS (
    SELECT *, CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END AS output
    FROM parts),
back AS (
    SELECT *, CASE form
        WHEN 'psm' THEN split_part(split_part(substr(output, 4), '<S>', 1), '<M>', 1) || split_part(output, '<M>', 2)
                        || split_part(split_part(output, '<S>', 2), '<M>', 1)
        WHEN 'spm' THEN split_part(split_part(output, '<P>', 2), '<M>', 1) || split_part(output, '<M>', 2) || split_part(substr(output, 4), '<P>', 1)
        ELSE output END AS again
    FROM made)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(output) AS output_sha256, sha256(again) AS restored_sha256
FROM back
"""

#: The checksum of a run is folded over its bytes with a table made from the
#: polynomial; near words meet by the word without one code point.
SPELLING = f"""
WITH RECURSIVE polynomial AS (
    SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
runs AS (
    SELECT coalesce(doc_id::VARCHAR, '') AS doc_id, {_FOLD.format("unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}'))")} AS run FROM documents),
counted AS (SELECT run, doc_id || ':' || run AS name, count(*) AS n FROM runs GROUP BY ALL),
bytes AS (SELECT run, n, hex(encode(name)) AS x FROM counted),
hashed AS (
    SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT,
        list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
        lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295) AS h
    FROM bytes, polynomial),
words AS (
    SELECT word, sum(n)::BIGINT AS n FROM (
        SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
    WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
places AS (SELECT word, n, unnest(range(length(word))) AS i FROM words),
struck AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM places),
near AS (
    SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM struck a JOIN struck b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, a.n, b.word, b.n FROM struck a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, b.n, a.word, a.n FROM struck a JOIN words b ON a.rest = b.word),
best AS (
    SELECT word, n, count(*) AS n_near, max(other_n) AS most, arg_min(other, (-other_n, other)) AS other FROM near GROUP BY word, n),
forms AS (
    SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.most >= 10 * w.n THEN b.other END AS form,
           CASE WHEN b.most >= 10 * w.n THEN b.most END AS form_n
    FROM words w LEFT JOIN best b ON b.word = w.word),
chain(word, stop) AS (
    SELECT word, word FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.stop WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.stop AS root FROM chain c JOIN forms f ON f.word = c.stop WHERE f.form IS NULL)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM forms f JOIN ends e ON e.word = f.word
"""

#: All windows of 400 bytes by their digest; texts in hexadecimal, so that a
#: byte is two characters.
REPEATS = """
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
windows AS (
    SELECT r, i, md5(substr(x, 2 * i + 1, 800)) AS m FROM (SELECT r, x, unnest(range(length(x) // 2 - 399)) AS i FROM texts)),
hits AS (SELECT r, i FROM windows WHERE m IN (SELECT m FROM windows GROUP BY m HAVING count(*) > 1)),
steps AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END AS fresh FROM hits),
runs AS (
    SELECT r, min(i) AS a, max(i) + 400 AS b
    FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS run FROM steps) GROUP BY r, run),
fronts AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS since FROM runs),
cut AS (
    SELECT f.r, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last,
           string_agg(substr(x, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS front
    FROM fronts f JOIN texts t ON t.r = f.r GROUP BY f.r)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN n_spans IS NULL THEN x ELSE front || substr(x, 2 * last + 1) END)) AS kept_sha256
FROM texts t LEFT JOIN cut c ON c.r = t.r
"""
