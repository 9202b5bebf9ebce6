"""DuckDB equivalents of those queries that SQL can express."""

WORDS = r"[^\x20\x09-\x0D]+"

#: What the line rules look for, written out here again: the SQL takes nothing from the operator.
CLOSING = """'"''”’»)]'"""
ENDS = ".!?:;…。！？"
SEPARATORS = "'|', '/', '>', '*', '»', '›', '•', '·'"
BOILERPLATE = (
    "all rights reserved|cookie policy|privacy policy|terms of use|terms of service|click here|read more|sign in|log in|subscribe to our newsletter|share on facebook|javascript|lorem ipsum"
    "|alle rechte vorbehalten|datenschutzerklärung|nutzungsbedingungen|cookie-richtlinie|hier klicken|klicken sie hier|weiterlesen|newsletter abonnieren|auf facebook teilen"
    "|tous droits réservés|politique de confidentialité|conditions d''utilisation|conditions générales|mentions légales|cliquez ici|lire la suite|abonnez-vous à notre newsletter|partager sur facebook"
    "|todos los derechos reservados|política de privacidad|política de cookies|términos de uso|condiciones de uso|aviso legal|haga clic aquí|leer más|suscríbete a nuestro boletín|compartir en facebook"
)
NAVIGATION = "home about contact blog news login logout register search menu sitemap help faq products services shop cart account startseite über uns kontakt aktuelles anmelden abmelden registrieren suche suchen menü hilfe produkte leistungen warenkorb konto impressum accueil propos actualités connexion déconnexion inscription recherche rechercher aide produits boutique panier compte inicio acerca nosotros contacto noticias entrar salir registrarse buscar menú ayuda productos servicios tienda carrito cuenta"

LINES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{WORDS}') AS ws FROM d),
base AS (SELECT doc_id, len(ws) AS n_words, coalesce(list_sum([length(x) for x in ws]), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols FROM w),
win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1) GROUP BY 1),
l AS (SELECT doc_id, line, i, regexp_extract_all(line, '{WORDS}') AS ws FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM d)),
ln AS (SELECT *, len(ws) AS n, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS dup FROM l WHERE len(ws) > 0),
v AS (SELECT doc_id, n, dup,
  len([x for x in ws if x IN ({SEPARATORS})]) >= 0.15::DOUBLE * n
  OR (n BETWEEN 3 AND 12 AND len([x for x in ws if list_contains(string_split('{NAVIGATION}', ' '), lower(x))]) >= n - 1)
  OR (regexp_matches(line, '[#*$%&|<>]') AND len([x for x in ws if regexp_matches(x, '[#*$%&|<>]')]) >= 0.3::DOUBLE * n)
  OR (contains(line, '!!') AND len([x for x in ws if x LIKE '%!!' AND x = upper(x)]) >= 0.6::DOUBLE * n)
  OR (n <= 40 AND regexp_matches(lower(line), '{BOILERPLATE}'))
  OR (n >= 8 AND rtrim(ws[n], {CLOSING}) = rtrim(ws[n], {CLOSING} || '{ENDS}')) AS bad FROM ln),
s AS (SELECT doc_id, count(*) FILTER (WHERE dup) AS n_dup_lines, coalesce(sum(n) FILTER (WHERE dup OR bad), 0) AS lost FROM v GROUP BY 1),
j AS (SELECT b.*, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(lost, 0)::BIGINT AS lost FROM base b LEFT JOIN rep ON rep.doc_id = b.doc_id LEFT JOIN s ON s.doc_id = b.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost <= 0.5 * n_words AS kept, n_words - lost AS words_left FROM j
"""

FOLDED = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {FOLDED} AS ws FROM documents), b AS (SELECT item_id, {FOLDED} AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS g FROM (SELECT item_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM (SELECT *, least(13, len(ws)) AS k FROM b WHERE len(ws) > 0))),
dw AS (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM iw) WHERE len(ws) >= k)),
h AS (SELECT doc_id, item_id, i, dw.k FROM dw JOIN iw ON dw.k = iw.k AND dw.g = iw.g),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM h)) GROUP BY 1),
m AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY 1)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(ws) AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""

WARC = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS d, regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1), '^www[.]', '') AS host,
  regexp_extract(lower(url), '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(lower(url), '^[^?#]+([?][^#]+)', 1) AS query FROM pages),
k AS (SELECT *, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END || query AS url_key, ((page_id % 315360000) + 315360000) % 315360000 AS captured, min(page_id) OVER (PARTITION BY d) AS rep FROM p)
SELECT page_id, strlen(html) AS payload_bytes, d AS payload_digest, CASE WHEN strlen(html) >= 100 AND rep <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN strlen(html) >= 100 AND rep <> page_id THEN rep END AS refers_to, row_number() OVER (ORDER BY url_key, captured, page_id) - 1 AS "position",
row_number() OVER (PARTITION BY url_key ORDER BY captured, page_id) AS nth, lag(page_id) OVER (PARTITION BY url_key ORDER BY captured, page_id) AS previous_id FROM k
"""

#: Seeded folds by CRC-32 (reflected, polynomial EDB88320), which DuckDB lacks.
CRC32 = """
tab AS (SELECT [list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) FOR n IN range(256)] AS t),
fold AS (SELECT doc_id, xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], [ascii(c)::BIGINT FOR c IN string_split(doc_id::VARCHAR, '')]), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS crc FROM (SELECT DISTINCT doc_id FROM documents), tab)"""

#: d of Good-Turing as katz.discounts has it, from counts n1 to n6 in a row of c.
DISCOUNTS = """
{out} AS (SELECT CASE WHEN list_min(n[1:5]) > 0 AND a <> 1 AND list_bool_and([((r + 1) * n[r + 1] / (n[r] * r)::DOUBLE - a) / (1 - a) > 0 AND ((r + 1) * n[r + 1] / (n[r] * r)::DOUBLE - a) / (1 - a) < 1 FOR r IN range(1, 6)])
  THEN [((r + 1) * n[r + 1] / (n[r] * r)::DOUBLE - a) / (1 - a) FOR r IN range(1, 6)] ELSE [(r - 0.5::DOUBLE) / r FOR r IN range(1, 6)] END AS d, n FROM
  (SELECT n, CASE WHEN n[1] > 0 THEN 6 * n[6] / n[1]::DOUBLE ELSE 1 END AS a FROM (SELECT [count(*) FILTER (WHERE c = 1), count(*) FILTER (WHERE c = 2), count(*) FILTER (WHERE c = 3), count(*) FILTER (WHERE c = 4), count(*) FILTER (WHERE c = 5), count(*) FILTER (WHERE c = 6)] AS n FROM {counts})))"""

KATZ = rf"""
WITH {CRC32},
x AS (SELECT d.doc_id, crc % 10 = 0 AS held_out, list_concat(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}'), [' end']) AS ws FROM documents d JOIN fold ON d.doc_id = fold.doc_id),
t AS (SELECT doc_id, held_out, unnest(ws) AS w, unnest(list_concat([' start'], ws[1:len(ws) - 1])) AS v, unnest(list_concat([NULL, ' start'], ws[1:len(ws) - 2])[1:len(ws)]) AS u FROM x),
u AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1),
tot AS (SELECT sum(c)::BIGINT AS big_n, count(*) AS big_v FROM u),
{DISCOUNTS.format(out="du", counts="u")},
mass AS (SELECT *, greatest(lft, 1::DOUBLE / (big_n + 1)) AS unseen FROM (SELECT d AS du, big_n, big_v, list_sum([n[r] * r * (1 - d[r]) FOR r IN range(1, 6)]) / big_n AS lft FROM du, tot)),
pu AS (SELECT w, c, CASE WHEN c <= 5 THEN du[c] ELSE 1 END * c / big_n * (1 - unseen) / (1 - lft) AS p FROM u, mass),
b AS (SELECT v, w, count(*) AS c FROM t WHERE NOT held_out GROUP BY ALL),
{DISCOUNTS.format(out="db", counts="b")},
h AS (SELECT v, sum(b.c) + (min(b.c) > 5)::INT AS base, CASE WHEN min(b.c) > 5 THEN 1 ELSE sum(CASE WHEN b.c <= 5 THEN (1 - d[b.c]) * b.c ELSE 0 END) END AS freed, sum(p) AS seen FROM b JOIN pu ON pu.w = b.w, db GROUP BY 1),
p2 AS (SELECT t.*, pu.c, CASE WHEN b.c IS NOT NULL THEN CASE WHEN b.c <= 5 THEN d[b.c] ELSE 1 END * b.c / h.base WHEN h.v IS NULL THEN coalesce(pu.p, unseen) ELSE freed / h.base / (1 - seen) * coalesce(pu.p, unseen) END AS p
  FROM t LEFT JOIN pu ON pu.w = t.w LEFT JOIN b ON b.v = t.v AND b.w = t.w LEFT JOIN h ON h.v = t.v, mass, db),
g AS (SELECT u, v, w, count(*) AS c, any_value(p) AS p FROM p2 WHERE NOT held_out AND u IS NOT NULL GROUP BY ALL),
{DISCOUNTS.format(out="dg", counts="g")},
k AS (SELECT u, v, sum(c) + (min(c) > 5)::INT AS base, CASE WHEN min(c) > 5 THEN 1 ELSE sum(CASE WHEN c <= 5 THEN (1 - d[c]) * c ELSE 0 END) END AS freed, sum(p) AS seen FROM g, dg GROUP BY ALL),
s AS (SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(p2.c) AS n_known, sum(log10((coalesce(p2.c, 0) + 0.1::DOUBLE) / (big_n + 0.1::DOUBLE * (big_v + 1)))) AS base_score,
  sum(log10(CASE WHEN g.c IS NOT NULL THEN CASE WHEN g.c <= 5 THEN d[g.c] ELSE 1 END * g.c / k.base WHEN k.v IS NULL THEN p2.p ELSE freed / k.base / (1 - seen) * p2.p END)) AS score
  FROM p2 LEFT JOIN g ON g.u = p2.u AND g.v = p2.v AND g.w = p2.w LEFT JOIN k ON k.u = p2.u AND k.v = p2.v, dg, tot GROUP BY 1)
SELECT doc_id, held_out, n_tokens, n_known, big_n AS train_tokens, base_score, score FROM s, tot
"""

#: CRC-32 of the distinct strings s of a table keys.
CRC32_OF = """
tab AS (SELECT [list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) FOR n IN range(256)] AS t),
crcs AS (SELECT s, xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], [ascii(c)::BIGINT FOR c IN string_split(s, '')]), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS crc FROM (SELECT DISTINCT s FROM keys), tab)"""

#: Best (cost, audit) to each grammar state row by row, from the front; inserted turns close each step.
CONVERSATIONS = rf"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
keys AS (SELECT s FROM raw),
{CRC32_OF},
d AS (SELECT conv_id, turn, CASE WHEN crc % 20 = 4 THEN 'user' ELSE role END AS role, CASE crc % 20 WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN crc % 20 = 3 THEN 2 ELSE 1 END)) AS c FROM raw JOIN crcs ON raw.s = crcs.s WHERE crc % 20 <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), c) AS i FROM d),
f AS (SELECT *, role[1] AS ini, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE 'k' END AS kind, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM o),
agg AS (SELECT conv_id, max(turn) AS hi, min(turn) AS lo, count(DISTINCT turn) AS n_turns, count(*) FILTER (WHERE kind = 'b') AS blank, count(*) FILTER (WHERE kind = 'd') AS duplicate, count(*) FILTER (WHERE kind = 't') AS truncated, count(*) FILTER (WHERE prev || ini NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY 1),
ins AS (SELECT * FROM (VALUES (0, 2, 'user:'), (1, 2, 'user:'), (2, 3, 'assistant:'), (3, 2, 'user:')) t(s, t, line)),
st AS (
  SELECT conv_id, 0::BIGINT AS i, x.s AS s, x.cost::BIGINT AS cost, x.audit AS audit, x.rep AS rep FROM agg, (VALUES (0, 0, '', NULL::VARCHAR), (2, 5, 'I', 'user:'), (3, 10, 'II', 'user:' || chr(10) || 'assistant:')) x(s, cost, audit, rep)
  UNION ALL
  SELECT conv_id, i, s, (z).c, (z).a, (z).r FROM (SELECT conv_id, i, s, min(struct_pack(c := cost, a := audit, r := rep)) AS z FROM (
    WITH e AS (
      SELECT st.conv_id, f.i, s, cost + 2 AS cost, audit || 'D' AS audit, rep FROM st JOIN f ON f.conv_id IS NOT DISTINCT FROM st.conv_id AND f.i = st.i + 1
      UNION ALL SELECT st.conv_id, f.i, CASE WHEN ini = 's' THEN 1 WHEN ini = 'u' THEN 2 ELSE 3 END, cost + CASE WHEN kind = 't' THEN 5 ELSE 0 END, audit || 'K', concat_ws(chr(10), rep, role || ':' || text) FROM st JOIN f ON f.conv_id IS NOT DISTINCT FROM st.conv_id AND f.i = st.i + 1
        WHERE kind IN ('k', 't') AND ((ini = 's' AND s = 0) OR (ini = 'u' AND s <> 2) OR (ini = 'a' AND s = 2))
      UNION ALL SELECT st.conv_id, f.i, ins.t, cost + CASE WHEN kind = 't' THEN 6 ELSE 1 END, audit || 'R', concat_ws(chr(10), rep, ins.line || text) FROM st JOIN ins ON ins.s = st.s JOIN f ON f.conv_id IS NOT DISTINCT FROM st.conv_id AND f.i = st.i + 1 WHERE kind IN ('k', 't')),
    e1 AS (SELECT conv_id, i, ins.t AS s, cost + 5 AS cost, audit || 'I' AS audit, concat_ws(chr(10), rep, ins.line) AS rep FROM e JOIN ins ON ins.s = e.s),
    e2 AS (SELECT conv_id, i, ins.t AS s, cost + 5 AS cost, audit || 'I' AS audit, concat_ws(chr(10), rep, ins.line) AS rep FROM e1 JOIN ins ON ins.s = e1.s)
    SELECT * FROM e UNION ALL SELECT * FROM e1 UNION ALL SELECT * FROM e2) GROUP BY conv_id, i, s)),
best AS (SELECT st.conv_id, min(struct_pack(c := cost, a := audit, r := rep)) AS z FROM st JOIN agg ON agg.conv_id IS NOT DISTINCT FROM st.conv_id AND st.i = agg.n WHERE s IN (0, 3) GROUP BY 1)
SELECT a.conv_id, coalesce(hi - lo + 1 - n_turns, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce((z).c, 0) AS cost, coalesce((z).a, '') AS audit, sha256(coalesce((z).r, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN agg ON agg.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM a.conv_id
"""

PHRASES = r"""
WITH p AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
u AS (SELECT lang, w, count(*) AS f FROM (SELECT lang, unnest(ws) AS w FROM p) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM u GROUP BY 1),
b AS (SELECT lang, x, y, count(*) AS f FROM (SELECT lang, unnest(ws[:-2]) AS x, unnest(ws[2:]) AS y FROM p WHERE len(ws) > 1) GROUP BY ALL),
t AS (SELECT lang, x, y, z, count(*) AS f FROM (SELECT lang, unnest(ws[:-3]) AS x, unnest(ws[2:-2]) AS y, unnest(ws[3:]) AS z FROM p WHERE len(ws) > 2) GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT lang, x, y, max(f) AS f FROM (SELECT lang, x, y, f FROM t UNION ALL SELECT lang, y, z, f FROM t) GROUP BY ALL),
k2 AS (SELECT b.lang, b.x || ' ' || b.y AS phrase, b.f AS a, u1.f AS l, u2.f AS r FROM b LEFT JOIN c ON c.lang = b.lang AND c.x = b.x AND c.y = b.y JOIN u u1 ON u1.lang = b.lang AND u1.w = b.x JOIN u u2 ON u2.lang = b.lang AND u2.w = b.y WHERE b.f >= 10 AND 100 * coalesce(c.f, 0) < 50 * b.f),
k3 AS (SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z AS phrase, t.f AS a, unnest([1, 2]) AS k, unnest([u1.f, b1.f]) AS l, unnest([b2.f, u3.f]) AS r FROM t JOIN u u1 ON u1.lang = t.lang AND u1.w = t.x JOIN u u3 ON u3.lang = t.lang AND u3.w = t.z JOIN b b1 ON b1.lang = t.lang AND b1.x = t.x AND b1.y = t.y JOIN b b2 ON b2.lang = t.lang AND b2.x = t.y AND b2.y = t.z),
s AS (SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM (SELECT lang, phrase, a, 1 AS k, l, r FROM k2 UNION ALL SELECT lang, phrase, a, k, l, r FROM k3)),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM m)
SELECT o.lang, rank, phrase, a, l, r, n, score FROM o JOIN n ON n.lang = o.lang WHERE rank <= 2000
"""
