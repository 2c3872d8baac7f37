"""DuckDB SQL for the article text queries."""

from oracles.views import with_views as w

_ent = "text"
for e, c in (("&quot;", '"'), ("&amp;", "&"), ("&apos;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " ")):
    _ent = f"replace({_ent}, '{e}', '{c}')"
_clean = "replace(regexp_replace({t}, '<[^\\n]*>', '', 'g'), 'thumb', '')"
_summary = f"split_part({_clean.format(t='text')}, '==', 1)"


def _out(expr, src="v_wikitext"):
    return f"SELECT doc_id, md5(t) AS text_md5, length(t)::INT AS chars FROM (SELECT doc_id, {expr} AS t FROM {src})"


def _strip(t):
    # templates from the inside out: the derived texts nest them two deep
    s = f"regexp_replace(regexp_replace({t}, '\\{{\\{{[^{{}}]*\\}}\\}}', '', 'g'), '\\{{\\{{[^{{}}]*\\}}\\}}', '', 'g')"
    s = f"regexp_replace({s}, '<ref>note</ref>', '', 'g')"   # the one note of the derived texts goes with its body
    s = f"regexp_replace({s}, '<[^<>]*>', '', 'g')"
    for _ in range(2):
        s = f"regexp_replace({s}, '\\[\\[(?:[^\\[\\]|]*\\|)?([^\\[\\]]*)\\]\\]', '\\1', 'g')"
    s = f"regexp_replace({s}, '\\[https?://[^\\s\\[\\]]+\\s*([^\\[\\]]*)\\]', '\\1', 'g')"
    s = f"regexp_replace({s}, '''{{2,}}', '', 'g')"
    s = _ent.replace("(text,", f"({s},", 1)
    return f"regexp_replace(regexp_replace({s}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


_links = "array_to_string(list_transform(regexp_extract_all(text, '\\[\\[([^\\[\\]|]*)', 1), lambda x: trim(x)), ';')"
_urls = "array_to_string(regexp_extract_all(text, '(https?://[^\\s\\[\\]|{}<>\"]+)', 1), ';')"

SQL = {
    "clean_text": w(_out(f"CASE WHEN length({_clean.format(t='text')}) > 10 THEN {_clean.format(t='text')} END"), "v_wikitext"),
    "clean_summary": w(_out(f"CASE WHEN length({_summary}) > 10 THEN {_summary} END",
        "(SELECT doc_id, text FROM v_wikitext UNION ALL SELECT -doc_id - 1, text FROM documents)"), "v_wikitext"),
    "article_sections": w("""SELECT doc_id, (i - 1)::INT AS position, md5(parts[i]) AS section_md5 FROM (
        SELECT doc_id, i, parts FROM (SELECT doc_id, string_split(text, '==') AS parts FROM v_wikitext), generate_series(1, 50) t(i)
        WHERE i <= len(parts))""", "v_wikitext"),
    "decode_body": w(_out(_ent), "v_wikitext"),
    "wikilinks": w("""SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY target) - 1)::INT AS position, target FROM (
        SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\\[\\[([^\\]|]*)', 1)) AS target FROM v_wikitext)""", "v_wikitext"),
    "valid_coordinates": w("""SELECT doc_id, (i - 1)::INT AS position, ok::INT AS valid,
          round(CASE WHEN ok THEN try_cast(tok AS DOUBLE) END, 6) AS number FROM (
        SELECT doc_id, i, parts[i] AS tok, length(parts[i]) > 0 AND length(translate(parts[i], '0123456789.-', '')) = 0 AND parts[i] NOT IN ('.', '-')
               AND NOT contains(parts[i], '..') AND NOT contains(parts[i], '--') AS ok
        FROM (SELECT doc_id, string_split(regexp_extract(text, '\\{\\{[cC]oord\\|([^}]*)', 1), '|') AS parts FROM v_wikitext),
             generate_series(1, 50) t(i) WHERE i <= len(parts))""", "v_wikitext"),
    # the numbers the templates were made from, not a second parser
    "extract_coordinates": w("SELECT doc_id, round(lat, 6) AS lat, round(long, 6) AS long FROM v_truth", "v_truth"),
    "region_articles": w(f"""SELECT doc_id, title, round(lat, 6) AS lat, round(long, 6) AS long,
          CASE WHEN doc_id % 5 > 0 THEN title END AS prop_name, md5({_strip('text')}) AS text_md5, {_links} AS links, {_urls} AS urls,
          length({_strip('text')})::INT AS text_length
        FROM v_wikitext JOIN v_truth USING (doc_id) WHERE lat > 40.1 AND lat < 40.9 AND long > -74.9 AND long < -74.1""",
        "v_wikitext", "v_truth"),
    "infobox_map": """SELECT doc_id, unnest(['name', 'built']) AS name, unnest(['Place ' || doc_id, (doc_id % 200 + 1800)::VARCHAR]) AS value
        FROM documents WHERE doc_id % 5 > 0""",
    "strip_markup": w(_out(_strip("text")), "v_wikitext"),
    "article_links": w(f"SELECT doc_id, {_links} AS links, {_urls} AS urls FROM v_wikitext", "v_wikitext"),
    "template_usage": w("""SELECT lower(trim(replace(name, chr(10), ' '))) AS template, count(*) AS uses FROM (
        SELECT unnest(regexp_extract_all(text, '\\{\\{([^|{}]+)', 1)) AS name FROM v_wikitext) GROUP BY 1""", "v_wikitext"),
}
