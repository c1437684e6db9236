"""DuckDB SQL for the same rows as the queries of ``queries.py``."""

from __future__ import annotations

from .fixed_values import CONTENTS_HEADINGS, DOCUMENT_TYPES, KEYWORD_LETTERS, NOISE_WORDS, SECTION_TYPES, STOPWORDS


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rewrite(column: str, rules: list[tuple[str, str]]) -> str:
    for pattern, replacement in rules:
        column = f"regexp_replace({column}, {_q(pattern)}, {_q(replacement)}, 'g')".replace("'\n'", "chr(10)").replace("'\n\n'", "chr(10)||chr(10)")
    return column


def _strip(column: str) -> str:
    return rf"regexp_replace({column}, '^\s+|\s+$', '', 'g')"


def _words(column: str) -> str:
    return rf"len(regexp_extract_all({column}, '\S+'))"


def _tokens(column: str) -> str:
    return f"CAST(trunc(length({column}) / 3.5) AS INTEGER)"


def _typed(column: str, kinds: dict[str, list[str]], default: str) -> str:
    cases = " ".join(f"WHEN {' OR '.join(f'contains(lower({column}), {_q(w)})' for w in words)} THEN {_q(kind)}" for kind, words in kinds.items())
    return f"CASE {cases} ELSE {_q(default)} END"


def _section_type(column: str) -> str:
    counts = {k: "(" + " + ".join(f"CAST(contains(lower({column}), {_q(w)}) AS INTEGER)" for w in words) + ")" for k, words in SECTION_TYPES.items()}
    best = f"greatest({', '.join(counts.values())})"
    return f"CASE WHEN {best} = 0 THEN 'general' " + " ".join(f"WHEN {n} = {best} THEN {_q(k)}" for k, n in counts.items()) + " END"


DOCS_MD = """docs_md AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)),
 lambda l, i: CASE WHEN trim(l, ' ') = '' THEN NULL WHEN i = 1 THEN '# ' || l WHEN (i - 1) % 4 = 2 THEN '## ' || l WHEN (i - 1) % 8 = 5 THEN '### ' || l ELSE l END),
 lambda x: x IS NOT NULL), chr(10)) AS text FROM documents)"""

ORDERS_MD = r"""orders_md AS (SELECT CAST(o_orderkey AS VARCHAR) AS document_id,
 '# ' || CASE o_orderstatus WHEN 'P' THEN 'CONTRAT' WHEN 'F' THEN 'FACTURE' ELSE 'DEVIS' END || ' ' || o_orderkey || chr(10) || '## Parties' || chr(10)
 || 'Société dénommée CLIENT ' || c_custkey || ' au capital de 50000 euros, SIREN ' || (o_orderkey + 100000000) || ' représentée par son gérant.' || chr(10)
 || 'Le bien se situe à ' || c_mktsegment || ' dans le secteur.' || chr(10) || 'Date: ' || strftime(o_orderdate, '%d/%m/%Y') || chr(10) || '## Prix et conditions' || chr(10)
 || 'Le prix est de ' || CAST(floor(o_totalprice) AS BIGINT) || ' euros avec une TVA de 20 \% et un paiement n^{\circ} ' || o_orderkey || ' selon les conditions &amp; annexes.' || chr(10)
 || 'Livraison<br>dans un <b>délai</b> de trois mois après signature.' || chr(10) || '| Poste | Montant |' || chr(10) || '| --- | --- |' || chr(10)
 || '| Total | ' || CAST(floor(o_totalprice) AS BIGINT) || ' |' AS text FROM orders JOIN customer ON o_custkey = c_custkey)"""

_CHAPTER = r"(?i)^\*{0,2}CHAPITRE\s+([IVXLCDM0-9]+)\s*[-–:]?\s*(.*?)\*{0,2}$"
_ARTICLE = r"(?i)^\*{0,2}Article\s+([A-Za-z0-9\s]+?\.?[0-9]*)\s*[-–:]?\s*(.*?)\*{0,2}$"
_NUMBERED = r"^([0-9]+\.[0-9]+\.[0-9]+(?:\.[0-9]+)?)\s*[-–:]?\s*(.+)$"
_CAPITALS = r"^[0-9]+/\s+([A-Z\s]{3,80})$"
_MARKDOWN = r"^(#{1,6})\s+(.+)$"


def _rest(pattern: str) -> str:
    return _strip(rf"regexp_replace({_strip(f'regexp_extract(line, {_q(pattern)}, 2)')}, '\*+', '', 'g')")


def _headers(lines: str) -> str:
    """CTE ``headed`` over a relation of ``document_id, pos, line``."""
    kind = f"CASE WHEN regexp_matches(line, {_q(_MARKDOWN)}) THEN 'm' WHEN regexp_matches(line, {_q(_CHAPTER)}) THEN 'c' WHEN regexp_matches(line, {_q(_CAPITALS)}) THEN 'u' WHEN regexp_matches(line, {_q(_ARTICLE)}) THEN 'a' WHEN regexp_matches(line, {_q(_NUMBERED)}) THEN 'n' END"
    numbered = f"regexp_extract(line, {_q(_NUMBERED)}, 1) || ' – ' || {_strip(f'regexp_extract(line, {_q(_NUMBERED)}, 2)')}"
    return f"""kinds AS (SELECT *, {kind} AS kind FROM {lines}),
headed AS (SELECT document_id, pos, line, CASE kind WHEN 'm' THEN (length(regexp_extract(line, {_q(_MARKDOWN)}, 1)) - 1) % 3 + 1 WHEN 'c' THEN 1 WHEN 'u' THEN 1 WHEN 'a' THEN 2 WHEN 'n' THEN 3 END AS level,
 CASE kind WHEN 'm' THEN left({_rest(_MARKDOWN)}, 100)
 WHEN 'c' THEN left('CHAPITRE ' || regexp_extract(line, {_q(_CHAPTER)}, 1) || CASE WHEN {_rest(_CHAPTER)} <> '' THEN ' - ' || {_rest(_CHAPTER)} ELSE '' END, 100)
 WHEN 'u' THEN left({_strip(f'regexp_extract(line, {_q(_CAPITALS)}, 1)')}, 100)
 WHEN 'a' THEN left('Article ' || {_strip(f'regexp_extract(line, {_q(_ARTICLE)}, 1)')} || CASE WHEN {_rest(_ARTICLE)} <> '' THEN ' – ' || {_rest(_ARTICLE)} ELSE '' END, 100)
 WHEN 'n' THEN left({numbered}, 100) END AS heading FROM kinds)"""


def _lines(docs: str) -> str:
    return rf"""lines AS (SELECT document_id, pos, line FROM (SELECT document_id, i - 1 AS pos, {_strip('l')} AS line FROM {docs}, unnest(string_split(text, chr(10))) WITH ORDINALITY AS t(l, i)) WHERE line <> '')"""


LINES = _lines("docs_md")

CARRIED = """groups AS (SELECT *, count(level) OVER w AS section_id, count(CASE WHEN level = 1 THEN 1 END) OVER w AS g1, count(CASE WHEN level <= 2 THEN 1 END) OVER w AS g2
 FROM headed WINDOW w AS (PARTITION BY document_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
carried AS (SELECT document_id, pos, line, level, heading, section_id,
 last_value(CASE WHEN level = 1 THEN heading END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h1,
 last_value(CASE WHEN level = 2 THEN heading END IGNORE NULLS) OVER (PARTITION BY document_id, g1 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h2,
 last_value(CASE WHEN level = 3 THEN heading END IGNORE NULLS) OVER (PARTITION BY document_id, g2 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h3 FROM groups)"""

SECTIONS = f"""bodies AS (SELECT document_id, section_id, min(h1) AS h1, min(h2) AS h2, min(h3) AS h3, string_agg(line, chr(10) ORDER BY pos) AS content, min(pos) AS first_pos FROM carried WHERE level IS NULL GROUP BY document_id, section_id),
counted AS (SELECT *, {_words('content')} AS word_count, CASE WHEN coalesce(upper(h1), '') IN ({', '.join(map(_q, CONTENTS_HEADINGS))}) THEN 'contents' WHEN {_words('content')} < 10 THEN 'short' END AS rejected FROM bodies),
sections AS (SELECT *, {_section_type('content')} AS type, {_tokens('content')} AS token_count,
 coalesce(nullif(concat_ws(' > ', nullif(h1, ''), nullif(h2, ''), nullif(h3, '')), ''), 'Section sans titre') AS title,
 row_number() OVER (PARTITION BY document_id ORDER BY section_id) AS position, count(*) OVER (PARTITION BY document_id) AS n_sections FROM counted WHERE rejected IS NULL)"""

_HEADER = "array_to_string(list_slice(string_split(text, chr(10)), 1, 50), chr(10))"


def _extract(pattern: str, column: str = _HEADER) -> str:
    return f"nullif(regexp_extract({column}, {_q(pattern)}, 1), '')"


_DATE = "coalesce(" + ", ".join(_extract(rf"\b({p})\b") for p in (r"\d{2}/\d{2}/\d{4}", r"\d{2}-\d{2}-\d{4}", r"\d{4}-\d{2}-\d{2}")) + ")"
_REFERENCE = "coalesce(" + ", ".join(map(_extract, (r"(?i)SIREN\s+(?:sous\s+le\s+numéro\s+)?(\d{9})", r"[Pp]ermis\s+(?:de\s+construire\s+)?n°?\s*([A-Z0-9\-]+)", r"[Rr]éférence\s*:?\s*([A-Z0-9\-]+)", r"n°\s*([A-Z0-9\-]{5,})"))) + ")"

_TITLE = r"regexp_extract(text, '(?m)^#\s+([^\n]+)', 1)"
ABOUT = f"""about AS (SELECT document_id, {_typed('text', DOCUMENT_TYPES, 'document')} AS document_type,
 CASE WHEN regexp_matches(text, '(?m)^#\\s+([^\\n]+)') THEN left({_strip(_TITLE)}, 150) ELSE coalesce(nullif(left({_strip("split_part(text, chr(10), 1)")}, 150), ''), 'Document sans titre') END AS document_title, {_REFERENCE} AS document_reference FROM docs_md)"""

CONTEXT = """placed AS (SELECT s.*, document_type, document_title, document_reference, concat_ws(' > ', document_title, nullif(h1, ''), nullif(h2, ''), nullif(h3, '')) AS breadcrumb,
 CASE WHEN coalesce(h3, '') <> '' THEN h2 WHEN coalesce(h2, '') <> '' THEN h1 END AS parent FROM sections s JOIN about USING (document_id))"""

KEYWORDS_OF = f"""tokens AS (SELECT document_id, section_id, i, w FROM sections, unnest(regexp_extract_all(regexp_replace(lower(content), '[^\\pL\\pN_]+', ' ', 'g'), '[^ ]+')) WITH ORDINALITY AS t(w, i)
 WHERE regexp_full_match(w, '[{KEYWORD_LETTERS}]{{5,}}') AND w NOT IN ({', '.join(map(_q, STOPWORDS))})),
frequent AS (SELECT document_id, section_id, w, count(*) AS n, min(i) AS first FROM tokens GROUP BY document_id, section_id, w),
ranked AS (SELECT document_id, section_id, w, row_number() OVER (PARTITION BY document_id, section_id ORDER BY n DESC, first) AS r FROM frequent),
keywords AS (SELECT document_id, section_id, string_agg(w, ',' ORDER BY r) AS keywords, count(*) AS n_keywords FROM ranked WHERE r <= 5 GROUP BY document_id, section_id)"""

OUTLINE = """nodes AS (SELECT document_id, 1 AS level, h1 AS title, NULL AS parent_h1, NULL AS parent_h2, min(position) AS position FROM sections WHERE coalesce(h1, '') <> '' GROUP BY document_id, h1
 UNION ALL SELECT document_id, 2, h2, h1, NULL, min(position) FROM sections WHERE coalesce(h1, '') <> '' AND coalesce(h2, '') <> '' GROUP BY document_id, h1, h2
 UNION ALL SELECT document_id, 3, h3, h1, h2, position FROM sections WHERE coalesce(h1, '') <> '' AND coalesce(h2, '') <> '' AND coalesce(h3, '') <> '')"""

SIBLINGS = """pairs AS (SELECT a.document_id, a.position, b.position AS place,
 CASE WHEN coalesce(a.h3, '') <> '' AND coalesce(b.h3, '') <> '' AND a.h1 IS NOT DISTINCT FROM b.h1 AND a.h2 IS NOT DISTINCT FROM b.h2 THEN b.h3
 WHEN coalesce(a.h2, '') <> '' AND coalesce(b.h2, '') <> '' AND coalesce(a.h3, '') = '' AND coalesce(b.h3, '') = '' AND a.h1 IS NOT DISTINCT FROM b.h1 THEN b.h2
 WHEN coalesce(a.h1, '') <> '' AND coalesce(b.h1, '') <> '' AND coalesce(a.h2, '') = '' AND coalesce(b.h2, '') = '' THEN b.h1 END AS beside
 FROM sections a JOIN sections b ON a.document_id = b.document_id AND (a.title <> b.title OR a.content <> b.content OR a.h1 IS DISTINCT FROM b.h1 OR a.h2 IS DISTINCT FROM b.h2 OR a.h3 IS DISTINCT FROM b.h3)),
siblings AS (SELECT document_id, position, string_agg(beside, '|' ORDER BY place) AS siblings, list(beside ORDER BY place) AS beside FROM pairs WHERE beside IS NOT NULL GROUP BY document_id, position)"""

_MD = ",\n".join([DOCS_MD, LINES, _headers("lines"), CARRIED, SECTIONS])
_FULL = ",\n".join([_MD, ABOUT, CONTEXT])
_SIGNS = ",\n".join([_FULL, KEYWORDS_OF, OUTLINE, SIBLINGS])


def _many(column: str, patterns: list[str]) -> str:
    return " + ".join(f"len(regexp_extract_all({column}, {_q(p)}))" for p in patterns)


_NOISE = _many("content", [r"\\{2,}", r"[\^_]{2,}", r"\|{2,}", r"#{3,}", r"[\x00-\x1F]"])
_SUSPECT = r"len(list_filter(regexp_extract_all(content, '\S+'), lambda w: length(w) > 20 OR NOT regexp_matches(w, '\pL') OR length(regexp_replace(w, '\P{Lu}', '', 'g')) > 0.5 * length(w)))"
_NOISE_WORD = rf"len(list_filter(regexp_extract_all(content, '\S+'), lambda w: w IN ({', '.join(map(_q, NOISE_WORDS))})))"
SCORES = rf"""signs AS (SELECT p.*, coalesce(n_keywords, 0) AS n_keywords, {_NOISE} AS noise, len(regexp_extract_all(content, '\\[a-z]+\{{')) AS latex, {_NOISE_WORD} AS noise_words, word_count >= 5 AND {_SUSPECT} / word_count > 0.3 AS gibberish,
 EXISTS (SELECT 1 FROM siblings b, unnest(b.beside) AS u(x) WHERE b.document_id = p.document_id AND b.position = p.position AND x NOT IN (SELECT title FROM sections t WHERE t.document_id = p.document_id)) AS bad_siblings
 FROM placed p LEFT JOIN keywords k USING (document_id, section_id)),
sums AS (SELECT document_id, count(*) AS n, sum(word_count) AS total_words, sum(noise) AS noise, sum(noise_words) AS noise_words, sum(latex) AS latex, count_if(gibberish) AS gibberish,
 sum(CASE WHEN coalesce(h3, '') <> '' AND coalesce(h2, '') = '' THEN 1 ELSE 0 END + CASE WHEN coalesce(h2, '') <> '' AND coalesce(h1, '') = '' THEN 1 ELSE 0 END) AS incoherent,
 count_if(word_count < 50) AS short, count_if(word_count > 500) AS long, count_if(n_keywords = 0) AS no_keywords, avg(n_keywords) AS avg_keywords, stddev_samp(word_count) / avg(word_count) AS cv,
 count_if(len(string_split(breadcrumb, '>')) < 2) AS bad_crumbs, array_to_string(list_slice(list(position ORDER BY position) FILTER (word_count < 50), 1, 5), ', ') AS short_at, array_to_string(list_slice(list(position ORDER BY position) FILTER (word_count > 500), 1, 5), ',') AS long_at, array_to_string(list_slice(list('Section ' || position || ': ' || CASE WHEN coalesce(h3, '') <> '' AND coalesce(h2, '') = '' THEN 'H3 sans H2' ELSE 'H2 sans H1' END ORDER BY position) FILTER ((coalesce(h3, '') <> '' AND coalesce(h2, '') = '') OR (coalesce(h2, '') <> '' AND coalesce(h1, '') = '')), 1, 3), ',') AS told, count_if(coalesce(h2, '') <> '' AND coalesce(parent, '') = '') AS orphans, count_if(bad_siblings) AS bad_siblings FROM signs GROUP BY document_id),
depths AS (SELECT document_id, max(level) AS depth FROM nodes GROUP BY document_id),
scores AS (SELECT a.*, sums.* EXCLUDE (document_id), depth, greatest(0.0, 30.0 - CASE WHEN n IS NULL THEN 30.0 ELSE least(10.0, noise * 0.5) + CASE WHEN noise_words > 0.05 * total_words THEN least(10.0, 100.0 * noise_words / total_words) ELSE 0 END + CASE WHEN latex > 5 THEN least(5.0, latex * 0.2) ELSE 0 END + least(5.0, gibberish * 0.5) END) AS ocr,
 greatest(0.0, 25.0 - CASE WHEN depth IS NULL THEN 10.0 ELSE CASE WHEN depth < 2 THEN 3.0 ELSE 0 END + CASE WHEN n < 5 THEN 5.0 WHEN n < 10 OR n > 100 THEN 2.0 ELSE 0 END + least(5.0, incoherent) END) AS structure,
 20.0 - CASE WHEN length(document_title) < 5 THEN 8.0 ELSE 0 END - CASE WHEN document_reference IS NULL THEN 4.0 ELSE 0 END - 3.0 AS metadata,
 greatest(0.0, 15.0 - CASE WHEN n IS NULL THEN 15.0 ELSE least(3.0, short * 0.3) + least(3.0, long * 0.3) + least(4.0, no_keywords * 0.2) + CASE WHEN n > 3 AND cv > 2 THEN 3.0 ELSE 0 END + CASE WHEN avg_keywords < 2 THEN 2.0 ELSE 0 END END) AS content,
 greatest(0.0, 10.0 - CASE WHEN n IS NULL THEN 10.0 ELSE least(3.0, bad_crumbs * 0.5) + least(2.0, orphans * 0.3) + least(2.0, bad_siblings * 0.2) END) AS coherence
 FROM about a LEFT JOIN sums USING (document_id) LEFT JOIN depths USING (document_id))"""
_SCORED = ",\n".join([_SIGNS, SCORES])


def _with(parts: str, select: str) -> str:
    return f"WITH {parts}\n{select}"


_LATEX = [(r"n\^\\circ", "n°"), (r"\^\{\\circ\}", "°"), (r"\$\\mathrm\{n\}\^\{\\circ\}\$", "n°"), (r"n\^\{\\circ\}", "n°"), (r"\$?([0-9]+)\s*\\%\$?", r"\1%"), (r"\$\\quad\$", " "), (r"\\square", "☐"), (r"\\mathrm\{([^}]+)\}", r"\1"), (r"\\\s", " "), (r"\$([^$]+)\$", r"\1"), (r"\{([^}]*)\}", r"\1"), (r"\{\}", ""), (r"\\\\", ""), (r"[ \t]+", " ")]
_MARKERS = [(r"<br\s*/?>", "\n"), (r"<(?:/[a-zA-Z]|[ac-zA-Z]|b[^r>])[^>]*>|<b>", ""), (r"!\[([^\]]*)\]\([^)]+\)", ""), (r"\|\s+\|\s+\|", ""), (r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n")]
_NOISY = "chr(7) || '  ' || text || chr(10) || chr(10) || chr(10) || 'fin' || chr(9) || chr(9) || '.'"
_PLACE = "coalesce(" + ", ".join(_extract(rf"(?i){p}\s+à\s+([A-Z][a-zA-Z\s\-]+)") for p in (r"se\s+situe", "située?", "localisée?", "sis")) + ")"
_LOCATION = rf"left({_strip(rf"split_part(regexp_replace({_strip(_PLACE)}, '\s+(dans|sur|par|pour)[^\n]*$', ''), chr(10), 1)")}, 50)"
_ENRICHED = f"{_strip("'[Document: ' || coalesce(nullif(document_title, ''), 'Document') || ' | Section ' || position || '/' || n_sections || ']' || chr(10) || '[' || coalesce(nullif(breadcrumb, ''), nullif(title, ''), '') || ']' || chr(10) || chr(10) || content")}"

_LEGAL = r"""legal_md AS (SELECT 'legal-' || doc_id AS document_id, array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l, i:
 CASE (i - 1) % 8 WHEN 0 THEN 'CHAPITRE ' || ((i - 1) % 19 + 1) || ' - ' || l WHEN 1 THEN '**Article 1.' || ((i - 1) % 19 + 1) || ' - ' || l || '**' WHEN 2 THEN '1.2.' || ((i - 1) % 19 + 1) || ' : ' || l
 WHEN 3 THEN ((i - 1) % 19 + 1) || '/ ' || regexp_replace(translate(left(l, 40), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^A-Z ]', '', 'g') WHEN 4 THEN '##### **' || l || '**' WHEN 5 THEN 'ARTICLE Ua ' || ((i - 1) % 19 + 1) WHEN 6 THEN 'Chapitre mixte' ELSE l || ' 1.2' END), chr(10)) AS text FROM documents)"""
_TURNS = r"""turns AS (SELECT conv_id, turn, '## ' || role || chr(10) || text AS markdown, CASE WHEN turn % 3 <> 2 THEN 90.0 + turn END AS confidence FROM conversations)"""

def _issue(when: str, severity: str, category: str, message: str, impact: str, extra: str = "''") -> str:
    """One issue as text behind its rank; ``severity`` is an SQL expression."""
    rank = f"CASE {severity} WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END"
    return f"CASE WHEN {when} THEN {{'rank': {rank}, 'text': {severity} || ':{category}:' || {message} || ':-' || {impact} || ' points' || {extra}}} END"


def _scaled(count: str, each: float, most: int) -> str:
    return f"format('{{:.1f}}', least({most}.0, {count} * {each}::DOUBLE))"


_ISSUES = [
    _issue("n IS NULL", "'error'", "ocr", "'Aucune section à évaluer'", "'30'"),
    _issue("noise > 0", "CASE WHEN least(10.0, noise * 0.5) < 5 THEN 'warning' ELSE 'error' END", "ocr", "noise || ' patterns de bruit détectés (LaTeX, symboles corrompus)'", _scaled("noise", 0.5, 10)),
    _issue("noise_words / total_words > 0.05", "'error'", "ocr", "'Ratio de bruit élevé : ' || format('{:.1f}', 100 * (noise_words / total_words)) || '%'", _scaled("(noise_words / total_words)", 100, 10)),
    _issue("latex > 5", "'warning'", "ocr", "latex || ' commandes LaTeX résiduelles détectées'", _scaled("latex", 0.2, 5)),
    _issue("gibberish > 0", "'warning'", "ocr", "gibberish || ' sections avec du texte incohérent'", _scaled("gibberish", 0.5, 5)),
    _issue("depth IS NULL", "'error'", "structure", "'Aucun plan hiérarchique détecté'", "'10'"),
    _issue("depth < 2", "'warning'", "structure", "'Hiérarchie peu profonde (depth=' || depth || ')'", "'3'"),
    _issue("depth IS NOT NULL AND n < 5", "'error'", "structure", "'Trop peu de sections (' || n || '), document mal découpé'", "'5'"),
    _issue("depth IS NOT NULL AND (n BETWEEN 5 AND 9 OR n > 100)", "'info'", "structure", "'Nombre de sections inhabituel (' || n || ')'", "'2'"),
    _issue("depth IS NOT NULL AND incoherent > 0", "'warning'", "structure", "incoherent || ' incohérences hiérarchiques'", "least(5, incoherent)", "':' || told"),
    _issue("length(document_title) < 5", "'error'", "metadata", "'Titre manquant ou invalide'", "'8'"),
    _issue("document_reference IS NULL", "'info'", "metadata", "'Référence du document manquante'", "'4'"),
    _issue("true", "'info'", "metadata", "'Aucune partie identifiée dans le document'", "'3'"),
    _issue("n IS NULL", "'error'", "content", "'Aucune section à évaluer'", "'15'"),
    _issue("short > 0", "'warning'", "content", "short || ' sections trop courtes (<50 mots)'", _scaled("short", 0.3, 3), "':' || replace(short_at, ' ', '')"),
    _issue("long > 0", "'info'", "content", "long || ' sections très longues (>500 mots)'", _scaled("long", 0.3, 3), "':' || long_at"),
    _issue("no_keywords > 0", "'warning'", "content", "no_keywords || ' sections sans mots-clés'", _scaled("no_keywords", 0.2, 4)),
    _issue("n > 3 AND cv > 2", "'info'", "content", "'Distribution très inégale des longueurs de sections'", "'3'"),
    _issue("avg_keywords < 2", "'warning'", "content", "'Faible densité d''information (avg ' || format('{:.1f}', avg_keywords) || ' mots-clés/section)'", "'2'"),
    _issue("n IS NULL", "'error'", "coherence", "'Aucune section à évaluer'", "'10'"),
    _issue("bad_crumbs > 0", "'warning'", "coherence", "bad_crumbs || ' breadcrumbs invalides'", _scaled("bad_crumbs", 0.5, 3)),
    _issue("orphans > 0", "'warning'", "coherence", "orphans || ' sections sans parent valide'", _scaled("orphans", 0.3, 2)),
    _issue("bad_siblings > 0", "'info'", "coherence", "bad_siblings || ' sections avec références siblings invalides'", _scaled("bad_siblings", 0.2, 2)),
]
_TOTAL = "CAST(format('{:.1f}', ocr + structure + metadata + content + coherence) AS DOUBLE)"
JUDGED = f"""listed AS (SELECT *, {_TOTAL} AS overall, list_filter([{', '.join(_ISSUES)}], lambda x: x IS NOT NULL) AS found FROM scores),
judged AS (SELECT *, array_to_string(list_concat(list_concat(list_filter(found, lambda x: x.rank = 0), list_filter(found, lambda x: x.rank = 1)), list_filter(found, lambda x: x.rank = 2)).list_transform(lambda x: x.text), '|') AS issues,
 array_to_string(list_filter([CASE WHEN ocr < 20 THEN '⚠️ Qualité OCR faible - envisager un retraitement avec de meilleurs paramètres' END, CASE WHEN structure < 15 THEN '⚠️ Structure mal détectée - vérifier le plan hiérarchique manuellement' END,
 CASE WHEN metadata < 10 THEN '⚠️ Métadonnées incomplètes - compléter manuellement le titre et la référence' END,
 CASE WHEN len(list_filter(found, lambda x: x.rank = 0)) > 0 THEN '🔴 ' || len(list_filter(found, lambda x: x.rank = 0)) || ' erreur(s) critique(s) détectée(s) - revue manuelle nécessaire' END,
 CASE WHEN len(list_filter(found, lambda x: x.rank = 1)) > 3 THEN '🟡 ' || len(list_filter(found, lambda x: x.rank = 1)) || ' avertissements - vérifier les sections signalées' END,
 CASE WHEN short > 0 THEN '📝 Vérifier les sections courtes : ' || short_at END], lambda x: x IS NOT NULL), '|') AS advice FROM listed)"""
MEASURED = """typed AS (SELECT document_id, map_from_entries(list(struct_pack(k := type, v := n) ORDER BY type)) AS by_type FROM (SELECT document_id, type, count(*) AS n FROM sections GROUP BY ALL) GROUP BY document_id),
measured AS (SELECT s.document_id, count(*) AS n_sections, CAST(sum(word_count) AS BIGINT) AS n_words, CAST(format('{:.1f}', avg(word_count)) AS DOUBLE) AS avg_words, min(word_count) AS min_words, max(word_count) AS max_words, any_value(by_type) AS sections_by_type,
 max(CASE WHEN coalesce(h1, '') <> '' AND coalesce(h2, '') <> '' THEN CASE WHEN coalesce(h3, '') <> '' THEN 3 ELSE 2 END ELSE 1 END) AS hierarchy_depth,
 count_if(coalesce(h1, '') <> '') AS n_h1, count_if(coalesce(h2, '') <> '') AS n_h2, count_if(coalesce(h3, '') <> '') AS n_h3, CAST(format('{:.1f}', avg(coalesce(n_keywords, 0))) AS DOUBLE) AS avg_keywords
 FROM sections s LEFT JOIN keywords USING (document_id, section_id) JOIN typed USING (document_id) GROUP BY s.document_id),
metrics AS (SELECT d.document_id, coalesce(n_sections, 0) AS n_sections, coalesce(n_words, 0) AS n_words, coalesce(avg_words, 0.0) AS avg_words, coalesce(min_words, 0) AS min_words, coalesce(max_words, 0) AS max_words, coalesce(sections_by_type, MAP {}) AS sections_by_type,
 coalesce(hierarchy_depth, 0) AS hierarchy_depth, coalesce(n_h1, 0) AS n_h1, coalesce(n_h2, 0) AS n_h2, coalesce(n_h3, 0) AS n_h3, coalesce(avg_keywords, 0.0) AS avg_keywords FROM docs_md d LEFT JOIN measured USING (document_id))"""

# Orders as cleaning leaves them.
_ROW = r"\|[^|]*\|[^|]*\|\n\| --- \| --- \|\n\| Total \| ([0-9-]+) \|$"
_CLEANED = _strip(_rewrite(_strip(_rewrite(f"regexp_replace(text, {_q(_ROW)}, 'Poste : Total. Montant : \\1.')", _MARKERS)), _LATEX))
ORDERS_CLEAN = f"docs_md AS (SELECT document_id, {_strip(_rewrite(f"replace({_CLEANED}, '&amp;', '&')", [(r'[ \t]{2,}', ' '), (r'\n{3,}', chr(10) * 2)]))} AS text FROM orders_md)"
_CHUNK_ID = "'chunk-' || document_id || '-' || lpad(CAST(position - 1 AS VARCHAR), CAST(greatest(3, length(CAST(position - 1 AS VARCHAR))) AS INTEGER), '0')"

# Long documents of a source, and documents whose lines are paragraphs.
SOURCE_MD = """docs_md AS (SELECT document_id, string_agg(part, chr(10) ORDER BY doc_id, part) AS text FROM (SELECT doc_id, concat_ws(':', source, CAST(CAST(floor(doc_id / 1000) AS BIGINT) AS VARCHAR)) AS document_id,
 concat_ws(chr(10), '# Document ' || doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN trim(x, ' ') <> '' THEN '## L' || doc_id || '.' || (i - 1) || chr(10) || x END), lambda x: x IS NOT NULL), chr(10))) AS part FROM documents) GROUP BY document_id)"""
# A section's group of small ones ends at the first follower that it cannot take, or that fills it; groups follow each other.
MERGED = """long AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY section_id) AS i FROM sections WHERE n_sections > 50),
reach AS (SELECT a.document_id, a.i, min(b.i) AS stop FROM (SELECT *, sum(word_count) OVER (PARTITION BY document_id ORDER BY i) AS upto FROM long) a JOIN (SELECT *, sum(word_count) OVER (PARTITION BY document_id ORDER BY i) AS upto FROM long) b
 ON a.document_id = b.document_id AND b.i BETWEEN a.i + 1 AND a.i + 50 WHERE a.word_count >= 50 OR b.upto - a.upto + a.word_count > 400 OR b.h1 IS DISTINCT FROM a.h1 OR b.upto - b.word_count - a.upto + a.word_count >= 50 GROUP BY a.document_id, a.i),
begins AS (SELECT document_id, i FROM long WHERE i = 1 UNION ALL SELECT r.document_id, r.stop FROM begins g JOIN reach r ON r.document_id = g.document_id AND r.i = g.i),
spans AS (SELECT document_id, i, lead(i, 1, 1000000000) OVER (PARTITION BY document_id ORDER BY i) AS next FROM begins),
merged AS (SELECT p.document_id, p.i AS place, arg_min(h1, l.i) AS h1, arg_min(h2, l.i) AS h2, arg_min(h3, l.i) AS h3, arg_min(title, l.i) AS title, string_agg(content, chr(10) || chr(10) ORDER BY l.i) AS content, CAST(sum(word_count) AS INTEGER) AS word_count, arg_min(token_count, l.i) AS token_count
 FROM spans p JOIN long l ON l.document_id = p.document_id AND l.i >= p.i AND l.i < p.next GROUP BY p.document_id, p.i UNION ALL SELECT document_id, section_id, h1, h2, h3, title, content, word_count, token_count FROM sections WHERE n_sections <= 50)"""


def _packed(source: str, separator: str) -> str:
    """CTEs ``parts`` (``key, part, content``) over a relation ``{source}`` of ``key, content``: pieces between separators packed up to the limit, one after the other."""
    gap = len(separator)
    sign = " || ".join(["chr(10)"] * gap)
    return f"""pieces AS (SELECT key, i, p, length(p) AS n FROM {source}, unnest(string_split(content, {sign})) WITH ORDINALITY AS t(p, i) WHERE length(content) > 1500 OR {_tokens('content')} > 512),
packing AS (SELECT key, i, n + {gap} AS cur, 0 AS part FROM pieces WHERE i = 1 UNION ALL SELECT key, i, CASE WHEN more > 1500 OR trunc(more / 3.5) > 512 THEN n + {gap} ELSE more END, part + CASE WHEN more > 1500 OR trunc(more / 3.5) > 512 THEN 1 ELSE 0 END
 FROM (SELECT p.key, p.i, p.n, g.cur + p.n + {gap} AS more, g.part FROM packing g JOIN pieces p ON p.key = g.key AND p.i = g.i + 1)),
parts AS (SELECT * FROM (SELECT key, part, {_strip(f"string_agg(p, {sign} ORDER BY i)")} AS content FROM packing JOIN pieces USING (key, i) GROUP BY key, part) WHERE {_words('content')} >= 10
 UNION ALL SELECT key, 0, content FROM {source} WHERE length(content) <= 1500 AND {_tokens('content')} <= 512)"""


_RECURSIVE = "WITH RECURSIVE"
# Ids as they are planted, what they become, and keys that tell rows apart.
ODD_IDS = """plain AS (SELECT document_id AS own, text FROM docs_md),
planted AS (SELECT CASE WHEN CAST(own AS BIGINT) % 7 = 0 THEN NULL WHEN CAST(own AS BIGINT) % 7 = 1 THEN '' WHEN CAST(own AS BIGINT) % 5 = 0 THEN 'shared-' || (CAST(own AS BIGINT) % 2) ELSE own END AS given, text, left(md5(text), 16) AS h FROM plain, range(2) AS r(k) WHERE k = 0 OR CAST(own AS BIGINT) % 7 = 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY coalesce(given, ''), h) AS copy FROM planted),
named AS (SELECT text, coalesce(nullif(given, ''), 'doc-' || h || CASE WHEN copy > 1 THEN '-' || copy ELSE '' END) AS name, coalesce(given, '') || ' ' || h || ' ' || copy AS document_id FROM numbered)"""
_PAGED = rf"""turned AS (SELECT conv_id, turn, {_strip(r"regexp_replace(regexp_replace('## ' || role || chr(10) || text, '!\[.*?\]\(.*?\)', '', 'g'), '\$([^$]+)\$', '\1', 'g')")} AS page, CASE WHEN turn % 3 <> 2 THEN 90.0 + turn END AS confidence FROM conversations),
placed_pages AS (SELECT *, coalesce(sum(len(string_split(page, chr(10))) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_line FROM turned),
docs_md AS (SELECT CAST(conv_id AS VARCHAR) AS document_id, string_agg(page, chr(10) || chr(10) ORDER BY turn) AS text, avg(confidence) AS ocr_confidence FROM turned GROUP BY conv_id)"""


def _request(columns: str, table: str, reject: str) -> str:
    """Requests of ``table`` (``r``, ``body_text`` and the columns that are given back) with the code of refused ones."""
    broken = "r % 11 IN (6, 7, 8)"
    return f"""SELECT r AS request_id, CASE WHEN NOT {broken} AND r % 3 <> 0 THEN CAST(r AS VARCHAR) END AS document_id, CASE WHEN NOT {broken} AND r % 11 <> 5 THEN 'u' END AS user_id, CASE WHEN NOT {broken} THEN 'p' END AS project_id,
 {columns}, reject_code FROM (SELECT *, CASE WHEN {broken} THEN 'MALFORMED_BODY' {reject} END AS reject_code FROM {table})"""


def _given(**columns: str) -> str:
    """Columns of accepted requests; page counts of others are 0."""
    return ", ".join(f"CASE WHEN reject_code IS NULL THEN {value} {'ELSE 0 ' * (name == 'page_count')}END AS {name}" for name, value in columns.items())


_SENT = "(SELECT doc_id AS r, coalesce(CASE WHEN doc_id % 11 = 3 THEN repeat(' ', 60) WHEN doc_id % 11 = 4 THEN left(text, 30) ELSE text END, '') AS body_text FROM documents)"
_SENT_PAGES = rf"(SELECT conv_id AS r, coalesce(string_agg(page, chr(10) || chr(10) ORDER BY turn) FILTER (conv_id % 11 <> 3), '') AS body_text, CAST(count(*) FILTER (conv_id % 11 <> 3) AS INTEGER) AS pages, avg(confidence) FILTER (conv_id % 11 <> 3) AS average FROM (SELECT conv_id, turn, {_strip(r"regexp_replace(regexp_replace('## ' || role || chr(10) || text, '!\[.*?\]\(.*?\)', '', 'g'), '\$([^$]+)\$', '\1', 'g')")} AS page, CASE WHEN turn % 3 <> 2 THEN 90.0 + turn END AS confidence FROM conversations) GROUP BY conv_id)"
_SIMILAR = """pairs AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: CAST(e.embedding[i] AS DOUBLE) * q.embedding[i])) / (sqrt(list_sum(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE) * x))) * sqrt(list_sum(list_transform(q.embedding, lambda x: CAST(x AS DOUBLE) * x)))), 6) AS similarity
 FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0)"""

ORACLE_SQL: dict[str, str] = {
    "valid_docs": "SELECT doc_id FROM documents WHERE length(coalesce(text, '')) >= 50 AND regexp_matches(text, '\\S')",
    "reject_reasons": _with(",\n".join([DOCS_MD, LINES, _headers("lines")]), f"""SELECT document_id, coalesce(CASE WHEN {_strip('text')} = '' THEN 'EMPTY_TEXT' WHEN length(text) < 50 THEN 'TEXT_TOO_SHORT' END, 'STRUCTURE_NOT_DETECTED') AS reject_code
 FROM docs_md d WHERE length(text) < 50 OR NOT EXISTS (SELECT 1 FROM headed h WHERE h.document_id = d.document_id AND level IS NOT NULL)"""),
    "clean_noise": f"SELECT doc_id, md5({_strip(_rewrite(_NOISY, [(r'[\x00-\x08\x0b\x0c\x0e-\x1f]', ''), (r'[ \t]{2,}', ' '), (r'\n{3,}', chr(10) * 2)]))}) AS cleaned FROM documents",
    "clean_latex": _with(ORDERS_MD, f"SELECT document_id, {_strip(_rewrite('text', _LATEX))} AS cleaned FROM orders_md"),
    "html_markers": _with(ORDERS_MD, f"SELECT document_id, {_strip(_rewrite('text', _MARKERS))} AS cleaned FROM orders_md"),
    "inline_headers": _with(ORDERS_MD, r"SELECT document_id, regexp_replace(replace(text, chr(10), ' '), '(\S)\s+(##\s+)', '\1' || chr(10) || '\2', 'g') AS text FROM orders_md"),
    "repeated_lines": rf"""SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, {_strip('l')} AS line FROM documents, unnest(string_split(text, chr(10))) AS t(l)) WHERE length(line) > 5 GROUP BY doc_id, line HAVING count(*) > 3""",
    "table_rows_to_sentences": _with(ORDERS_MD, "SELECT document_id, regexp_replace(text, '\\|[^|]*\\|[^|]*\\|\\n\\| --- \\| --- \\|\\n\\| Total \\| ([0-9-]+) \\|$', 'Poste : Total. Montant : \\1.') AS cleaned FROM orders_md"),
    "doc_type": _with(ORDERS_MD, f"SELECT document_id, {_typed('text', DOCUMENT_TYPES, 'document')} AS document_type FROM orders_md"),
    "title_subtitle": _with(ORDERS_MD, rf"SELECT document_id, left({_strip(_TITLE)}, 150) AS document_title, {_strip("regexp_extract(text, '(?m)^##\\s+([^\\n]+)', 1)".replace(chr(92) * 2, chr(92)))} AS document_subtitle FROM orders_md"),
    "doc_date": _with(ORDERS_MD, f"SELECT document_id, {_DATE} AS document_date FROM orders_md"),
    "doc_reference": _with(ORDERS_MD, f"SELECT document_id, {_REFERENCE} AS document_reference FROM orders_md"),
    "location": _with(ORDERS_MD, f"SELECT document_id, {_LOCATION} AS location FROM orders_md"),
    "header_lines": _with(f"{DOCS_MD},\n{_LEGAL},\nboth_md AS (SELECT document_id, text FROM docs_md UNION ALL SELECT document_id, text FROM legal_md),\n{_lines('both_md')},\n{_headers('lines')}", "SELECT document_id, pos, level, heading FROM headed WHERE level IS NOT NULL"),
    "heading_carry_forward": _with(",\n".join([DOCS_MD, LINES, _headers("lines"), CARRIED]), "SELECT document_id, pos, section_id, h1, h2, h3 FROM carried"),
    "sections": _with(_MD, "SELECT document_id, section_id, h1, h2, h3, md5(content) AS content, word_count FROM counted"),
    "toc_and_short_rejects": _with(_MD, "SELECT document_id, section_id, rejected FROM counted WHERE rejected IS NOT NULL"),
    "section_titles": _with(_MD, "SELECT document_id, position, title FROM sections"),
    "section_types": _with(_MD, "SELECT document_id, position, type FROM sections"),
    "type_histogram": _with(_MD, "SELECT document_id, type, count(*) AS count FROM sections GROUP BY ALL"),
    "keywords_top5": _with(f"{_MD},\n{KEYWORDS_OF}", "SELECT document_id, section_id, keywords FROM keywords"),
    "token_estimate": f"SELECT doc_id, {_tokens('text')} AS tokens FROM documents",
    "oversize_sections": _with(_MD, "SELECT document_id, position FROM sections WHERE length(content) > 1500 OR token_count > 512"),
    "outline_nodes": _with(f"{_MD},\n{OUTLINE}", "SELECT document_id, level, title, parent_h1, parent_h2, position FROM nodes"),
    "outline_depth": _with(f"{_MD},\n{OUTLINE}", "SELECT document_id, max(level) AS depth, count(*) AS nodes FROM nodes GROUP BY document_id"),
    "breadcrumbs": _with(_FULL, "SELECT document_id, position, breadcrumb FROM placed"),
    "parents": _with(_FULL, "SELECT document_id, position, parent FROM placed"),
    "siblings": _with(f"{_MD},\n{SIBLINGS}", "SELECT s.document_id, s.position, coalesce(siblings, '') AS siblings FROM sections s LEFT JOIN siblings USING (document_id, position)"),
    "enriched": _with(_FULL, f"SELECT document_id, position, md5({_ENRICHED}) AS enriched FROM placed"),
    "chunks": _with(f"{_FULL},\n{KEYWORDS_OF}", f"""SELECT 'chunk-' || document_id || '-' || lpad(CAST(position - 1 AS VARCHAR), CAST(greatest(3, length(CAST(position - 1 AS VARCHAR))) AS INTEGER), '0') AS chunk_id, document_id, document_type, title, type, word_count, token_count,
 {_tokens(_ENRICHED)} AS enriched_token_count, coalesce(keywords, '') AS keywords, position, breadcrumb FROM placed LEFT JOIN keywords USING (document_id, section_id)"""),
    "doc_stats": _with(_MD, "SELECT document_id, count(section_id) AS n_sections, coalesce(sum(word_count), 0) AS n_words, coalesce(sum(token_count), 0) AS n_tokens, coalesce(CAST(round_even(avg(word_count), 0) AS BIGINT), 0) AS avg_words, coalesce(CAST(round_even(avg(token_count), 0) AS BIGINT), 0) AS avg_tokens FROM docs_md LEFT JOIN sections USING (document_id) GROUP BY document_id"),
    "page_flatten": _with(_TURNS, rf"SELECT CAST(conv_id AS VARCHAR) AS document_id, md5(string_agg({_strip(r"regexp_replace(regexp_replace(markdown, '!\[.*?\]\(.*?\)', '', 'g'), '\$([^$]+)\$', '\1', 'g')")}, chr(10) || chr(10) ORDER BY turn)) AS text FROM turns GROUP BY conv_id"),
    "page_confidence": _with(_TURNS, "SELECT CAST(conv_id AS VARCHAR) AS document_id, round(avg(confidence), 6) AS confidence FROM turns GROUP BY conv_id"),
    "q_scores": _with(_SCORED, "SELECT document_id, round(ocr, 3) AS ocr, round(structure, 3) AS structure, round(metadata, 3) AS metadata, round(content, 3) AS content, round(coherence, 3) AS coherence FROM scores"),
    "quality_grade": _with(_SCORED, "SELECT document_id, CASE WHEN t >= 86 THEN 'Excellent' WHEN t >= 71 THEN 'Bon' WHEN t >= 41 THEN 'Moyen' ELSE 'Mauvais' END AS grade, t < 71 AS needs_review FROM (SELECT document_id, round(ocr + structure + metadata + content + coherence, 9) AS t FROM scores)"),
    "q_gibberish": _with(_MD, f"SELECT document_id, position FROM sections WHERE word_count >= 5 AND {_SUSPECT} / word_count > 0.3"),
    "quality_metrics": _with(f"{_MD},\n{KEYWORDS_OF},\n{MEASURED}", "SELECT * REPLACE (CAST(to_json(sections_by_type) AS VARCHAR) AS sections_by_type) FROM metrics"),
    "metric_summary": """SELECT operation, count(*) AS count, round(avg(duration_ms), 2) AS avg_ms, round(min(duration_ms), 2) AS min_ms, round(max(duration_ms), 2) AS max_ms, round(avg(success), 3) AS success_rate
 FROM (SELECT event_type AS operation, value AS duration_ms, CAST(value < 100 AS INTEGER) AS success, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 1000 GROUP BY operation""",
    "rate_per_minute": "SELECT user_id, date_trunc('minute', ts) AS minute, count(*) AS requests, count(*) > 10 AS limited FROM events GROUP BY ALL",
    "log_counts": "SELECT user_id, count(*) AS requests FROM events WHERE event_type = 'click' GROUP BY user_id",
    "vector_top5": _with(_SIMILAR, "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM pairs) WHERE rank <= 5"),
    "document_lookup": "SELECT doc_id, lang, source FROM documents WHERE doc_id = 42",
    "latest_states": "SELECT doc_id, arg_max(state, updated_at) AS state FROM (SELECT doc_id, 'pending' AS state, 0 AS updated_at FROM documents UNION ALL SELECT doc_id, 'done', 1 FROM labels) GROUP BY doc_id",
    "html_entities": "SELECT CAST(page_id AS VARCHAR) AS document_id, replace(replace(replace(replace(replace(replace(coalesce(html, ''), '<h1>', chr(10) || '# '), '</h1>', chr(10)), '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&') AS text FROM pages",
    "html_tables_to_md": "SELECT o_orderkey, 'avant | Clé | Montant |' || chr(10) || '|---|---|' || chr(10) || '| ' || o_orderkey || ' | ' || CAST(floor(o_totalprice) AS BIGINT) || ' | après' AS text FROM orders",
    "parties_siren_window": _with(ORDERS_MD, rf"""SELECT document_id, concat_ws('|', 'vendor: ' || nullif({_strip(r"regexp_extract(text, '[Ss]ociété\s+dénommée\s+([A-Z][A-Za-z0-9\s\-'']+?)\s+au\s+capital', 1)")}, ''),
 'other: ' || nullif({_strip(r"regexp_extract(substring(text, greatest(1, strpos(text, 'SIREN') - 100), least(100, strpos(text, 'SIREN') - 1)), '[A-Z][A-Za-z0-9\s\-'']{5,}')")}, '')) AS parties FROM orders_md"""),
    "split_parts": f"""{_RECURSIVE} para AS (SELECT CAST(doc_id AS VARCHAR) AS key, {_strip("replace(coalesce(text, ''), chr(10), chr(10) || chr(10))")} AS content FROM documents),
{_packed('para', chr(10) * 2)}
SELECT key AS document_id, part, 'T' || CASE WHEN part > 0 THEN ' (suite ' || part || ')' ELSE '' END AS title, CASE WHEN part > 0 THEN 'H2 (suite ' || part || ')' END AS h3, {_words('content')} AS word_count, {_tokens('content')} AS token_count, md5(content) AS content FROM parts""",
    "capped_sections": f"""{_RECURSIVE} {_MD},
keyed_sections AS (SELECT *, {{'d': document_id, 's': section_id}} AS key FROM sections),
{_packed('keyed_sections', chr(10))}
SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY section_id, part) AS position, title || CASE WHEN part > 0 THEN ' (suite ' || part || ')' ELSE '' END AS title,
 CASE WHEN coalesce(h3, '') <> '' THEN h3 || CASE WHEN part > 0 THEN ' (suite ' || part || ')' ELSE '' END WHEN part > 0 AND coalesce(h2, '') <> '' THEN h2 || ' (suite ' || part || ')' ELSE h3 END AS h3,
 {_words('p.content')} AS word_count, {_tokens('p.content')} AS token_count, md5(p.content) AS content FROM parts p JOIN keyed_sections USING (key)""",
    "consolidated": f"""{_RECURSIVE} {",".join([SOURCE_MD, LINES, _headers("lines"), CARRIED, SECTIONS])},
{MERGED}
SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY place) AS position, h1, h2, h3, title, {_section_type('content')} AS type, word_count, token_count, count(*) OVER (PARTITION BY document_id) AS n_sections, md5(content) AS content FROM merged""",
    "order_chunks": _with(",\n".join([ORDERS_MD, ORDERS_CLEAN, LINES, _headers("lines"), CARRIED, SECTIONS, ABOUT, CONTEXT]), f"SELECT {_CHUNK_ID} AS chunk_id, document_type, document_title, document_reference, title, type, word_count, {_ENRICHED} AS enriched_content FROM placed"),
    "outline_tree": _with(f"{_MD},\n{OUTLINE}", """SELECT n.document_id, CAST(to_json(list({'level': 1, 'title': title, 'position': position, 'children': coalesce(children, [])} ORDER BY position, title)) AS VARCHAR) AS nodes FROM nodes n LEFT JOIN
 (SELECT m.document_id, m.parent_h1, list({'level': 2, 'title': title, 'position': position, 'children': coalesce(children, [])} ORDER BY position, title) AS children FROM nodes m LEFT JOIN
 (SELECT document_id, parent_h1, parent_h2, list({'level': 3, 'title': title, 'position': position, 'children': []::VARCHAR[]} ORDER BY position, title) AS children FROM nodes WHERE level = 3 GROUP BY ALL) l
 ON l.document_id = m.document_id AND l.parent_h1 = m.parent_h1 AND l.parent_h2 = m.title WHERE level = 2 GROUP BY m.document_id, m.parent_h1) b ON b.document_id = n.document_id AND b.parent_h1 = n.title WHERE level = 1 GROUP BY n.document_id"""),
    "q_issues": _with(f"{_SCORED},\n{JUDGED}", "SELECT document_id, overall, issues, CASE WHEN advice = '' THEN '✅ Document bien traité - aucune action requise' ELSE advice END AS recommendations FROM judged"),
    "score_report": _with(f"{_SCORED},\n{JUDGED},\n{MEASURED}", """SELECT document_id, overall AS overall_score, CASE WHEN t >= 86 THEN 'Excellent' WHEN t >= 71 THEN 'Bon' WHEN t >= 41 THEN 'Moyen' ELSE 'Mauvais' END AS grade, t < 71 AS needs_review,
 CAST(to_json({'ocr_quality': round(ocr, 3)::DOUBLE, 'structure_quality': round(structure, 3)::DOUBLE, 'metadata_completeness': round(metadata, 3)::DOUBLE, 'content_quality': round(content, 3)::DOUBLE, 'coherence': round(coherence, 3)::DOUBLE}) AS VARCHAR) AS scores, len(found) AS n_issues,
 CAST(to_json(m) AS VARCHAR) AS metrics FROM (SELECT *, round(ocr + structure + metadata + content + coherence, 9) AS t FROM judged) j JOIN (SELECT document_id, {'n_sections': n_sections, 'n_words': n_words, 'avg_words': avg_words, 'min_words': min_words, 'max_words': max_words, 'sections_by_type': sections_by_type,
 'hierarchy_depth': hierarchy_depth, 'n_h1': n_h1, 'n_h2': n_h2, 'n_h3': n_h3, 'avg_keywords': avg_keywords} AS m FROM metrics) USING (document_id)"""),
    "row_keys": _with(",\n".join([DOCS_MD, ODD_IDS, _lines("named"), _headers("lines"), CARRIED, SECTIONS]), """SELECT 'chunk-' || name || '-' || lpad(CAST(position - 1 AS VARCHAR), CAST(greatest(3, length(CAST(position - 1 AS VARCHAR))) AS INTEGER), '0') AS chunk_id, name AS document_id, title, position, md5(content) AS content FROM sections JOIN (SELECT document_id, name FROM named) USING (document_id)"""),
    "response_totals": _with(_MD, "SELECT document_id, count(section_id) AS n_chunks, coalesce(sum(word_count), 0) AS n_words, coalesce(sum(token_count), 0) AS n_tokens, coalesce(sum(token_count), 0) // greatest(count(section_id), 1) AS tokens_per_chunk FROM docs_md LEFT JOIN sections USING (document_id) GROUP BY document_id"),
    "chunk_json": _with(",\n".join([_PAGED, LINES, _headers("lines"), CARRIED, SECTIONS, ABOUT, CONTEXT, KEYWORDS_OF, SIBLINGS]), f"""SELECT {_CHUNK_ID} AS chunk_id, CASE WHEN page.confidence IS NULL THEN CAST(to_json({{{{'chunk_id': {_CHUNK_ID}, 'document_id': document_id, 'user_id': 'u', 'project_id': 'p', 'content': content, 'enriched_content': {_ENRICHED}, 'metadata': {{{{META, 'page_number': page.turn}}}}}}}}) AS VARCHAR)
 ELSE CAST(to_json({{{{'chunk_id': {_CHUNK_ID}, 'document_id': document_id, 'user_id': 'u', 'project_id': 'p', 'content': content, 'enriched_content': {_ENRICHED}, 'metadata': {{{{META, 'page_number': page.turn, 'confidence': page.confidence::DOUBLE}}}}}}}}) AS VARCHAR) END AS json
 FROM placed LEFT JOIN keywords USING (document_id, section_id) LEFT JOIN siblings USING (document_id, position) JOIN (SELECT document_id, ocr_confidence FROM docs_md) USING (document_id) ASOF JOIN (SELECT CAST(conv_id AS VARCHAR) AS document_id, turn, confidence, first_line FROM placed_pages) page ON placed.document_id = page.document_id AND placed.first_pos >= page.first_line""".replace("{{", "{").replace("}}", "}").replace("META", f"'chunkIndex': position - 1, 'h1': h1, 'h2': h2, 'h3': h3, 'title': title, 'type': type, 'wordCount': word_count, 'tokenCount': token_count, 'enrichedTokenCount': {_tokens(_ENRICHED)}, 'keywords': coalesce(string_split(keywords, ','), []), 'breadcrumb': breadcrumb, 'sectionPosition': position, 'documentType': document_type, 'documentTitle': document_title, 'documentReference': document_reference, 'ocrSource': 'mistral-ocr-3', 'ocrConfidence': ocr_confidence, 'parentSection': parent, 'siblingSections': coalesce(beside, []), 'source': 'mistral-ocr-3'")),
    "ocr_requests": _request(_given(text="md5(body_text)", source="CASE WHEN r % 2 = 0 THEN 'paddleocr' ELSE 'pymupdf' END", page_count="CAST(r % 9 AS INTEGER)", confidence="CAST(r % 100 / 2 AS DOUBLE)"), _SENT, f"WHEN {_strip('body_text')} = '' THEN 'EMPTY_TEXT' WHEN length(body_text) < 50 THEN 'TEXT_TOO_SHORT' WHEN r % 11 = 5 THEN 'MISSING_OWNER'"),
    "markdown_requests": _request(_given(text="md5(body_text)", source="'pymupdf'", page_count="0", confidence="CAST(NULL AS DOUBLE)"), _SENT, f"WHEN length(body_text) < 50 THEN 'TEXT_TOO_SHORT' WHEN r % 11 = 5 THEN 'MISSING_OWNER' WHEN {_strip('body_text')} = '' THEN 'OCR_PROCESSING_ERROR'"),
    "paged_requests": _request(_given(text="md5(body_text)", source="'mistral-ocr-3'", page_count="pages", confidence="average"), _SENT_PAGES, "WHEN pages = 0 THEN 'NO_PAGES' WHEN r % 11 = 5 THEN 'MISSING_OWNER' WHEN length(body_text) < 50 THEN 'TEXT_TOO_SHORT'"),
    "vector_within": _with(_SIMILAR, "SELECT * FROM pairs WHERE similarity >= 0.7"),
}
