"""SQL counterparts of the registered queries, for DuckDB.

Written from the operators' meaning over the same tables: token tables, joins and
windows where the Spark side works inside the row. Word lists and patterns are the
only shared parts, passed in as literals.
"""

from __future__ import annotations

from checks import adapters as A
from newsmood.functions import lexicon as L
from newsmood.functions.text import BOILERPLATE, WS
from newsmood.operators import textjobs as J

ORACLE: dict[str, str] = {}

NOT_WS = "[^" + WS[1:]
AS_OF = "TIMESTAMP '2024-03-01 00:00:00'"
PUNCT = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"


def strings(items) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in items)


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{WS}+'), lambda w: w <> '')"


def clean(x: str) -> str:
    out = collapse(f"coalesce({x}, '')")
    for phrase in BOILERPLATE:
        out = f"replace({out}, '{phrase}', '')"
    return f"trim({out})"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


ART = """art AS (
  SELECT trim(substr(split_part(text, chr(10), 1), 1, 80)) AS title, text AS content,
         concat('https://news.example.org/', md5(text)) AS url, source,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id % 20000 AS INTEGER)) AS published_date,
         TIMESTAMP '2024-01-02 00:00:00' + to_hours(CAST(doc_id % 20000 AS INTEGER)) AS scraped_date,
         lang AS category,
         CASE doc_id % 3 WHEN 0 THEN 'rss' WHEN 1 THEN 'api' ELSE 'website' END AS source_type,
         doc_id AS seq
  FROM documents)"""


def analysis(x_title: str = "title", x_content: str = "content", limit: int | None = None) -> str:
    w = words(f"concat({x_title}, '. ', {x_content})")
    return f"array_to_string({w if limit is None else f'list_slice({w}, 1, {limit})'}, ' ')"


# --- rule scores -------------------------------------------------------------------------------

_LISTS = (
    "lex(term, v) AS (VALUES "
    + ", ".join(f"('{t.replace(chr(39), chr(39) * 2)}', {v})" for t, v in L.Lexicon().valence.items())
    + "), boost(term, b) AS (VALUES "
    + ", ".join(f"('{t}', {v})" for t, v in L.Lexicon().boost.items())
    + "), neg(term) AS (VALUES "
    + ", ".join(f"('{t.replace(chr(39), chr(39) * 2)}')" for t in sorted(L.Lexicon().negation))
    + "), pol(term, p, s) AS (VALUES "
    + ", ".join(f"('{t}', {p}, {s})" for t, (p, s) in L.Lexicon().polarity.items())
    + ")"
)


def rule(src: str, keys: str, text: str, out: str = "rule") -> str:
    """CTEs ending in ``out(keys, txt, compound, pos, neg, neu)`` for a text column of ``src``."""
    k = ", ".join(f"t.{x}" for x in keys.split(", "))
    same = lambda a, b: " AND ".join(f"{a}.{x} = {b}.{x}" for x in keys.split(", "))
    return f"""
{out}_txt AS (SELECT {keys}, {text} AS txt FROM {src}),
{out}_tok AS (
  SELECT {keys}, txt, string_split(txt, ' ') AS cased,
         list_transform(string_split(lower(txt), ' '), lambda w: trim(w, '{PUNCT}')) AS low
  FROM {out}_txt),
{out}_pos AS (SELECT t.*, unnest(range(1, len(low) + 1)) AS i FROM {out}_tok t),
{out}_hit AS (
  SELECT {k}, t.i, t.low, lex.v * 100000 // 10 AS unit_v, sign(lex.v) AS sg,
         t.cased[t.i] = upper(t.cased[t.i]) AND t.cased[t.i] <> lower(t.cased[t.i]) AS shout,
         len(list_filter(t.cased, lambda w: NOT (w = upper(w) AND w <> lower(w)))) > 0 AS mixed,
         coalesce(list_position(t.low, 'but'), 0) AS but_at
  FROM {out}_pos t JOIN lex ON lex.term = t.low[t.i]),
{out}_val AS (
  SELECT {k},
    (unit_v + sg * (CASE WHEN shout AND mixed THEN 73300 ELSE 0 END)
      + sg * (coalesce(b1.b, 0) * 29300 + coalesce(b2.b, 0) * 27835 + coalesce(b3.b, 0) * 26370))
    * CASE WHEN n1.term IS NOT NULL OR n2.term IS NOT NULL OR n3.term IS NOT NULL THEN -74 ELSE 100 END
    * CASE WHEN but_at = 0 OR i = but_at THEN 10 WHEN i < but_at THEN 5 ELSE 15 END AS val
  FROM {out}_hit t
  LEFT JOIN boost b1 ON i > 1 AND b1.term = low[i - 1]
  LEFT JOIN boost b2 ON i > 2 AND b2.term = low[i - 2]
  LEFT JOIN boost b3 ON i > 3 AND b3.term = low[i - 3]
  LEFT JOIN neg n1 ON i > 1 AND n1.term = low[i - 1]
  LEFT JOIN neg n2 ON i > 2 AND n2.term = low[i - 2]
  LEFT JOIN neg n3 ON i > 3 AND n3.term = low[i - 3]),
{out}_sum AS (
  SELECT {keys}, sum(CASE WHEN val > 0 THEN val ELSE 0 END) AS p, sum(CASE WHEN val < 0 THEN val ELSE 0 END) AS n,
         count(*) FILTER (val > 0) AS np, count(*) FILTER (val < 0) AS nn
  FROM {out}_val GROUP BY ALL),
{out}_all AS (
  SELECT {k}, t.txt, CAST(coalesce(p, 0) AS BIGINT) AS p, CAST(coalesce(n, 0) AS BIGINT) AS n,
         coalesce(np, 0) AS np, coalesce(nn, 0) AS nn, len(low) AS nw,
         least(4, length(txt) - length(replace(txt, '!', ''))) * 29200000
         + CASE WHEN length(txt) - length(replace(txt, '?', '')) <= 1 THEN 0
                WHEN length(txt) - length(replace(txt, '?', '')) <= 3
                THEN (length(txt) - length(replace(txt, '?', ''))) * 18000000
                ELSE 96000000 END AS emph
  FROM {out}_tok t LEFT JOIN {out}_sum s ON {same("s", "t")}),
{out}_mass AS (
  SELECT *, CAST(p + n + sign(p + n) * emph AS DOUBLE) / 100000000.0::DOUBLE AS x,
    CAST(p + np * 100000000 + CASE WHEN p + n > 0 THEN emph ELSE 0 END AS BIGINT) AS mp,
    CAST(-n + nn * 100000000 + CASE WHEN p + n < 0 THEN emph ELSE 0 END AS BIGINT) AS mn,
    CAST((nw - np - nn) * 100000000 AS BIGINT) AS mu
  FROM {out}_all),
{out} AS (
  SELECT {keys}, txt, x / sqrt(x * x + 15.0::DOUBLE) AS compound,
    coalesce(mp::DOUBLE / nullif(mp + mn + mu, 0)::DOUBLE, 0) AS pos,
    coalesce(mn::DOUBLE / nullif(mp + mn + mu, 0)::DOUBLE, 0) AS neg,
    coalesce(mu::DOUBLE / nullif(mp + mn + mu, 0)::DOUBLE, 0) AS neu
  FROM {out}_mass)"""


COMPOUND_LABEL = "CASE WHEN compound >= 0.05 THEN 'positive' WHEN compound <= -0.05 THEN 'negative' ELSE 'neutral' END"
LEX_CONF = """least(1.0::DOUBLE,
  (CASE WHEN abs(compound) >= 0.5 THEN 0.8::DOUBLE WHEN abs(compound) >= 0.1 THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END)
  + (CASE WHEN greatest(pos, neg, neu) >= 0.7 THEN 0.2::DOUBLE
          WHEN greatest(pos, neg, neu) >= 0.5 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END))"""


def lexical(src: str = "art", keys: str = "seq", title: str = "title", content: str = "content") -> str:
    """CTEs ending in ``lexd(keys, label, confidence, compound, pos, neg, neu)``."""
    return (
        rule(src, keys, analysis(title, content))
        + f""",
lexd AS (SELECT {keys}, {COMPOUND_LABEL} AS label, {LEX_CONF} AS confidence, compound, pos, neg, neu FROM rule)"""
    )


def polar(src: str, keys: str, text: str, out: str) -> str:
    """CTEs ending in ``out(keys, polarity, subjectivity)``."""
    k = ", ".join(f"t.{x}" for x in keys.split(", "))
    return f"""
{out}_tok AS (
  SELECT {keys}, unnest(string_split(lower({text}), ' ')) AS raw FROM {src}),
{out}_sum AS (
  SELECT {k}, sum(p) AS p, sum(s) AS s, count(*) AS n
  FROM {out}_tok t JOIN pol ON pol.term = trim(raw, '{PUNCT}') GROUP BY ALL),
{out} AS (
  SELECT {k}, coalesce(p::DOUBLE / (n * 100.0::DOUBLE), 0) AS polarity,
         coalesce(s::DOUBLE / (n * 100.0::DOUBLE), 0) AS subjectivity
  FROM {src} t LEFT JOIN {out}_sum USING ({keys}))"""


POL_LABEL = "CASE WHEN polarity > 0.1 THEN 'positive' WHEN polarity < -0.1 THEN 'negative' ELSE 'neutral' END"
POL_BASE = "least(1.0::DOUBLE, abs(polarity) + subjectivity * 0.5::DOUBLE)"
POL_CONF = f"CASE WHEN abs(polarity) >= 0.5 THEN least(1.0::DOUBLE, {POL_BASE} + 0.2::DOUBLE) ELSE {POL_BASE} END"


def polarity(src: str = "art") -> str:
    return (
        f"ana AS (SELECT seq, {analysis()} AS txt FROM {src}),"
        + polar("ana", "seq", "txt", "pl")
        + f""",
pold AS (SELECT seq, {POL_LABEL} AS label, {POL_CONF} AS confidence, polarity, subjectivity FROM pl)"""
    )


TIDY = f"""tidy AS (
  SELECT * REPLACE ({strip("title")} AS title, {strip("content")} AS content) FROM art
  WHERE title <> '' AND content <> '' AND url <> '')"""
UNIQUE = """uniq AS (
  SELECT t.*, label AS sentiment_label, confidence AS sentiment_confidence
  FROM tidy t JOIN lexd USING (seq)
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq) = 1)"""
SCORED_UNIQUE = f"WITH {_LISTS}, {ART}, {TIDY}, {lexical('tidy')}, {UNIQUE}"

N_WORDS = f"len({words('content')})"


def stored(where: str = "true", name: str = "st", created: str = "published_date") -> str:
    """CTE ``name``: stored rows, the last per URL, unscored where ``seq % 5 = 4``; needs ``lexd``."""
    return f"""{name} AS (
  SELECT art.*, CASE WHEN seq % 5 <> 4 THEN label END AS sentiment_label,
         CASE WHEN seq % 5 <> 4 THEN confidence END AS sentiment_confidence,
         CAST({N_WORDS} AS INTEGER) AS word_count,
         CAST(greatest(1, {N_WORDS} // 200) AS INTEGER) AS reading_time,
         {created} AS created_at, {created} AS updated_at
  FROM art JOIN lexd USING (seq) WHERE {where}
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq DESC) = 1)"""


STORED = f"WITH {_LISTS}, {ART}, {lexical()}, {stored()}"
MEAN = "CAST(sum(CAST({0} AS DECIMAL(20,12))) AS DOUBLE) / count({0})"

# --- counts ------------------------------------------------------------------------------------

ORACLE["sentiment_by_source"] = f"""{SCORED_UNIQUE}, n AS (
  SELECT source, count(*) AS total,
    count(*) FILTER (sentiment_label = 'positive') AS n_positive,
    count(*) FILTER (sentiment_label = 'negative') AS n_negative,
    count(*) FILTER (sentiment_label = 'neutral') AS n_neutral
  FROM uniq GROUP BY source)
SELECT *, n_positive::DOUBLE / total * 100 AS pct_positive, n_negative::DOUBLE / total * 100 AS pct_negative,
  n_neutral::DOUBLE / total * 100 AS pct_neutral FROM n"""

ORACLE["sentiment_stats"] = f"""{STORED}
SELECT count(*) AS total_articles, count(sentiment_label) AS analyzed_articles,
  count(*) FILTER (sentiment_label = 'positive') AS positive,
  count(*) FILTER (sentiment_label = 'negative') AS negative,
  count(*) FILTER (sentiment_label = 'neutral') AS neutral FROM st"""

_SUMMARY = """, tot AS (
  SELECT count(*) AS articles_processed, CAST(sum(CAST(sentiment_confidence AS DECIMAL(20,12))) AS DOUBLE) AS s
  FROM {0} WHERE sentiment_label IS NOT NULL)
SELECT sentiment_label AS label, count(*) AS n, any_value(articles_processed) AS articles_processed,
  any_value(s) / any_value(articles_processed) AS average_confidence
FROM {0}, tot WHERE sentiment_label IS NOT NULL GROUP BY 1"""
ORACLE["analysis_summary"] = STORED + _SUMMARY.format("st")
ORACLE["ingest_to_summary"] = SCORED_UNIQUE + _SUMMARY.format("uniq")

ORACLE["articles_by_source"] = "SELECT source, count(*) AS n_articles FROM documents GROUP BY source"

ORACLE["sentiment_share"] = f"""{SCORED_UNIQUE}
SELECT sentiment_label AS label, count(*) AS n,
  count(*)::DOUBLE / (SELECT count(*) FROM uniq) * 100 AS pct FROM uniq GROUP BY 1"""

ORACLE["top_confident"] = f"""{SCORED_UNIQUE}
SELECT sentiment_label AS label, title, url, sentiment_confidence AS confidence, seq FROM uniq
WHERE sentiment_label IN ('positive', 'negative')
QUALIFY row_number() OVER (PARTITION BY sentiment_label ORDER BY sentiment_confidence DESC, seq) = 1"""

ORACLE["report_summary"] = f"""{STORED}, a AS (
  SELECT count(*)::DOUBLE AS total, count(sentiment_label)::DOUBLE AS analyzed, count(DISTINCT source)::DOUBLE AS src,
    count(*) FILTER (sentiment_label = 'positive')::DOUBLE AS p, count(*) FILTER (sentiment_label = 'negative')::DOUBLE AS n,
    count(*) FILTER (sentiment_label = 'neutral')::DOUBLE AS u,
    {MEAN.format("sentiment_confidence")} AS conf FROM st)
SELECT 'Total Articles' AS metric, total AS value FROM a
UNION ALL SELECT 'Analyzed Articles', analyzed FROM a
UNION ALL SELECT 'Analysis Coverage', analyzed / total * 100 FROM a
UNION ALL SELECT 'Positive Sentiment', p FROM a WHERE p > 0
UNION ALL SELECT 'Positive Sentiment Percent', p / analyzed * 100 FROM a WHERE p > 0
UNION ALL SELECT 'Negative Sentiment', n FROM a WHERE n > 0
UNION ALL SELECT 'Negative Sentiment Percent', n / analyzed * 100 FROM a WHERE n > 0
UNION ALL SELECT 'Neutral Sentiment', u FROM a WHERE u > 0
UNION ALL SELECT 'Neutral Sentiment Percent', u / analyzed * 100 FROM a WHERE u > 0
UNION ALL SELECT 'Average Confidence', conf FROM a WHERE analyzed > 0
UNION ALL SELECT 'Number of Sources', src FROM a WHERE analyzed > 0"""

REGISTRY = """reg AS (
  SELECT DISTINCT CASE WHEN source_type = 'api' AND source = 'src1' THEN 'NewsAPI'
                       WHEN source_type = 'api' AND source = 'src2' THEN 'GNews'
                       ELSE concat(upper(substr(source, 1, 1)), lower(substr(source, 2))) END AS name,
    source_type AS type,
    concat(CASE WHEN source_type = 'rss' THEN 'https://rss.' ELSE 'https://www.' END, source, '.example.com/news') AS url
  FROM art)"""
ORACLE["source_registry_stats"] = f"""WITH {ART}, {REGISTRY}
SELECT coalesce(type, 'total') AS type, count(*) AS n_sources FROM reg GROUP BY ROLLUP (type)"""
ORACLE["select_sources"] = f"""WITH {ART}, {REGISTRY}
SELECT 'token' AS rule, name, type, url FROM reg
WHERE type = 'rss' OR lower(name) IN ('newsapi', 'gnews') OR contains(lower(name), 'rss') OR contains(lower(name), 'rc1')
UNION ALL SELECT 'type', name, type, url FROM reg WHERE type = 'website'"""

ORACLE["validate_scores"] = """SELECT source, count(*) AS n,
  count(*) FILTER (doc_id % 5 <> 0 AND length(text)::DOUBLE / 3000.0::DOUBLE <= 1 AND doc_id % 7 <> 0) AS n_valid
FROM documents GROUP BY source"""

# --- filters -----------------------------------------------------------------------------------

ORACLE["clean_articles"] = f"""WITH {ART}, raw AS (
  SELECT * REPLACE (
    CASE WHEN seq % 29 = 0 THEN '' ELSE concat(chr(9), ' ', title, ' ') END AS title,
    CASE WHEN seq % 31 = 0 THEN NULL ELSE content END AS content) FROM art)
SELECT seq, url, {strip("title")} AS title, md5({strip("content")}) AS content, source FROM raw
WHERE coalesce(title, '') <> '' AND coalesce(content, '') <> ''
QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq) = 1"""

_TC = "lower(concat(title, ' ', content))"
ORACLE["keyword_filter_ci"] = f"""WITH {ART} SELECT seq, source FROM art
WHERE contains({_TC}, 'worthless') OR contains({_TC}, 'license') OR contains({_TC}, 'an entanglement')
   OR contains({_TC}, 'étre') OR contains({_TC}, '100%')"""
ORACLE["keyword_semi_join"] = f"""WITH {ART}, kw AS (
  SELECT DISTINCT lower(unnest({words("text")})) AS k FROM benchmark UNION SELECT lower(text) FROM benchmark)
SELECT seq, source FROM art WHERE EXISTS (SELECT 1 FROM kw WHERE k <> '' AND contains({_TC}, k))"""
ORACLE["keyword_semi_join_items"] = f"""WITH {ART}, w AS (SELECT text, {words("text")} AS w FROM benchmark), kw AS (
  SELECT lower(array_to_string(list_slice(w, i, i + 4), ' ')) AS k
  FROM (SELECT w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM w) UNION SELECT lower(text) FROM w)
SELECT seq, source FROM art WHERE EXISTS (SELECT 1 FROM kw WHERE k <> '' AND contains({_TC}, k))"""
_LIKE = """(content LIKE '%est%' OR title LIKE '%est%' OR content LIKE '%the%ing%' OR title LIKE '%the%ing%'
   OR content LIKE '%_or %' OR title LIKE '%_or %')"""
ORACLE["query_articles"] = f"""{STORED}
SELECT url, seq, source, published_date, sentiment_confidence FROM st
WHERE {_LIKE} AND sentiment_label = 'negative'
  AND published_date BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-09-30 23:00:00'
ORDER BY published_date DESC, url LIMIT 50"""
ORACLE["article_by_url"] = f"""{STORED}
SELECT url, seq, source, word_count FROM st WHERE url = (SELECT min(url) FROM art)"""
ORACLE["valid_article_urls"] = """WITH h AS (
  SELECT page_id, url, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages), l AS (
  SELECT page_id, url AS link FROM h
  UNION ALL SELECT page_id, concat(url, '#', x) FROM (SELECT page_id, url, unnest(h) AS x FROM h)
  UNION ALL SELECT page_id, concat('https://x.example.org/Page', x, '.PDF') FROM (SELECT page_id, unnest(h) AS x FROM h)
  UNION ALL SELECT page_id, concat('https://x.example.org/news', x) FROM (SELECT page_id, unnest(h) AS x FROM h))
SELECT page_id, count(*) AS n_links, count(*) FILTER (NOT regexp_matches(link,
  '(?i)/tag/|/category/|/author/|/page/|/search/|/archive/|/contact/|/about/|\\.pdf$|\\.jpg$|\\.png$|\\.gif$|#|mailto:|javascript:'
)) AS n_valid FROM l GROUP BY page_id"""
ORACLE["cap_per_source"] = f"""WITH {ART}, hit AS (
  SELECT source, seq, contains({_TC}, 'est') OR contains({_TC}, 'the') AS ok FROM art)
SELECT 'before' AS mode, source, seq FROM (
  SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY source ORDER BY seq) <= 20) WHERE ok
UNION ALL SELECT 'after', source, seq FROM (SELECT * FROM hit WHERE ok)
QUALIFY row_number() OVER (PARTITION BY source ORDER BY seq) <= 20"""

# --- text jobs ---------------------------------------------------------------------------------

ORACLE["word_reading_stats"] = f"""WITH {ART}
SELECT seq, {N_WORDS} AS word_count, greatest(1, {N_WORDS} // 200) AS reading_time FROM art"""
ORACLE["clean_text"] = f"""WITH {ART} SELECT seq, md5({clean(
    "concat(title, ' Read  more ', content, ' Click', chr(9), 'here Subscribe to Sign up')")}) AS text FROM art"""
_W = WS[1:-1]
URL_RE = "http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\\\(\\\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
EMAIL_RE = "\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{2,}\\b"
PHONE_RE = f"(?:\\+?1[-.{_W}]?)?\\(?[0-9]{{3}}\\)?[-.{_W}]?[0-9]{{3}}[-.{_W}]?[0-9]{{4}}"
_RAW = "concat(content, ' see https://example.org/a?b=1%20c; or mail x.y@example.org ')"
_SCRUB = f"regexp_replace({_RAW}, '{URL_RE}', '', 'g')"
_SCRUB = f"regexp_replace({_SCRUB}, '{EMAIL_RE}', '', 'g')"
_SCRUB = f"regexp_replace({_SCRUB}, '{PHONE_RE}', '', 'g')"
ORACLE["scrub_pii"] = f"WITH {ART} SELECT seq, md5({collapse(_SCRUB)}) AS text FROM art"


def decode(x: str) -> str:
    for reference, text in REFERENCES:
        x = f"replace({x}, '{reference}', '{text}')"
    return x


# Every reference that the pages and their added tails hold.
REFERENCES = (
    ("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&eacute;", "é"), ("&rarr;", "→"),
    ("&lt x", "< x"), ("&#150;", "–"), ("&#0;", "�"), ("&#xD800;", "�"), ("&#9999999;", "�"), ("&notit;", "¬it;"), ("&#00233;", "é"),
    ("&frac34x", "¾x"), ("&#x1F600;", "😀"), ("&copy2024", "©2024"), ("&amp;", "&"),
)
_TAILED = "(SELECT page_id, url, replace(html, '</article>', concat(" + (
    f"[{', '.join(repr(t) for t in A.TAILS)}][page_id % {len(A.TAILS)} + 1]"
) + ", '</article>')) AS html FROM pages)"


_TAGS = "regexp_replace({0}, '<[^>]+>', '', 'g')"
ORACLE["strip_html"] = f"SELECT page_id, md5({collapse(decode(_TAGS.format('html')))}) AS text FROM {_TAILED}"
ORACLE["analysis_text"] = f"WITH {ART} SELECT seq, md5({analysis(limit=1000)}) AS text FROM art"

_EXTRA = """concat(content, '. On ', strftime(published_date, '%B %-d, %Y'), ' or ', strftime(published_date, '%-m/%-d/%Y'),
 ' (', strftime(published_date, '%Y-%m-%d'), '), Acme ', upper(substr(source, 1, 1)), substr(source, 2),
 ' & Sons Group paid $', seq, '.50 and ', seq, ' dollars in Old Town City, see http://example.org/', seq,
 ' or a', seq, '@example.org.')"""
_ENT = {
    "organizations": [f"\\b[A-Z][a-zA-Z&.{_W}]+(?:{J.ORG_SUFFIX})\\b"],
    "locations": [f"\\b[A-Z][a-zA-Z{_W}]+(?:{J.LOCATION_SUFFIX})\\b"],
    "money": [f"(?i)\\$[0-9,]+(?:\\.[0-9]{{2}})?|\\b[0-9,]+{WS}*(?:dollars?|USD|cents?)\\b"],
    "dates": [
        "\\b\\d{1,2}/\\d{1,2}/\\d{4}\\b",
        "\\b\\d{4}-\\d{1,2}-\\d{1,2}\\b",
        f"(?i)\\b(?:{J.MONTHS})[a-z]*{WS}+\\d{{1,2}},?{WS}+\\d{{4}}\\b",
    ],
    "emails": [EMAIL_RE],
    "urls": [URL_RE],
}
ORACLE["extract_entities"] = f"WITH {ART}, x AS (SELECT seq, {_EXTRA} AS t FROM art) " + " UNION ".join(
    f"SELECT seq, '{kind}' AS kind, unnest(regexp_extract_all(t, '{p}')) AS entity FROM x"
    for kind, patterns in _ENT.items()
    for p in patterns
)

_SENT = f"""sent AS (
  SELECT seq, row_number() OVER (PARTITION BY seq ORDER BY o) - 1 AS idx, s FROM (
    SELECT seq, unnest(list_transform(string_split_regex(content, '[.!?]+'), lambda s: {strip("s")})) AS s,
           generate_subscripts(string_split_regex(content, '[.!?]+'), 1) AS o FROM art) WHERE s <> '')"""
_IMPORTANT = "".join(
    f" + ((length(lower(s)) - length(replace(lower(s), '{w}', '')))::DOUBLE / {len(w)}) * 0.5::DOUBLE"
    for w in J.IMPORTANT_WORDS
)
ORACLE["summarize"] = f"""WITH {ART}, {_SENT}, n AS (SELECT seq, count(*) AS n FROM sent GROUP BY seq), sc AS (
  SELECT seq, idx, s, (n - idx) * 0.1::DOUBLE{_IMPORTANT}
    + CASE WHEN len({words("s")}) BETWEEN 10 AND 30 THEN 1.0::DOUBLE ELSE 0 END AS score
  FROM sent JOIN n USING (seq) WHERE n > 3), top AS (
  SELECT seq, s FROM sc QUALIFY row_number() OVER (PARTITION BY seq ORDER BY score DESC, idx) <= 3), pick AS (
  SELECT seq, idx, s FROM sc SEMI JOIN top USING (seq, s)
  QUALIFY row_number() OVER (PARTITION BY seq ORDER BY idx) <= 3), made AS (
  SELECT seq, concat(string_agg(s, '. ' ORDER BY idx), '.') AS summary FROM pick GROUP BY seq)
SELECT seq, md5(coalesce(summary, content)) AS summary FROM art LEFT JOIN made USING (seq)"""


def keyword_sql(pattern: str, stop, score: str) -> str:
    return f"""WITH {ART}, tok AS (
  SELECT seq, unnest(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]+')) AS word,
         generate_subscripts(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]+'), 1) AS pos FROM art), ok AS (
  SELECT * FROM tok WHERE regexp_matches(word, '{pattern}') AND word NOT IN ({strings(stop)})), cnt AS (
  SELECT seq, word, count(*) AS n, min(pos) AS first_pos FROM ok GROUP BY ALL), tot AS (
  SELECT *, sum(n) OVER (PARTITION BY seq) AS total FROM cnt)
SELECT seq, row_number() OVER (PARTITION BY seq ORDER BY {score} DESC, first_pos) AS rank, word, n FROM tot
QUALIFY rank <= 10"""


ORACLE["keywords_tfidf"] = keyword_sql(
    "^\\p{L}{3,}$", J.NEWS_STOP_WORDS, "(n::DOUBLE / total::DOUBLE) * ln(total::DOUBLE / n::DOUBLE)"
)
ORACLE["keywords_frequency"] = keyword_sql("^[a-z]{3,}$", J.BASIC_STOP_WORDS, "n")


def top5(src: str, key: str, text: str, k: int = 5, out: str = "kw") -> str:
    """CTEs ending in ``out(key, keywords)``: the most frequent words joined with '|'."""
    return f"""{out}_tok AS (
  SELECT {key}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+')) AS word,
         generate_subscripts(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+'), 1) AS pos FROM {src}), {out}_n AS (
  SELECT {key}, word, count(*) AS n, min(pos) AS pos FROM {out}_tok
  WHERE regexp_matches(word, '^[a-z]{{3,}}$') AND word NOT IN ({strings(J.BASIC_STOP_WORDS)}) GROUP BY ALL), {out}_top AS (
  SELECT * FROM {out}_n QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY n DESC, pos) <= {k}), {out} AS (
  SELECT {key}, string_agg(word, '|' ORDER BY n DESC, pos) AS keywords FROM {out}_top GROUP BY ALL)"""


ORACLE["readability"] = f"""WITH {ART}, w AS (
  SELECT seq, unnest({words("content")}) AS w FROM art), syl AS (
  SELECT seq, sum(CASE WHEN regexp_replace(w, '[^a-zA-Z]', '', 'g') = '' THEN 0
    ELSE greatest(1, len(regexp_extract_all(regexp_replace(w, '[^a-zA-Z]', '', 'g'), '[aeiouyAEIOUY]+'))) END)::BIGINT AS syllables
  FROM w GROUP BY seq), m AS (
  SELECT seq, len(regexp_extract_all(content, '[.!?]+')) AS sentences, {N_WORDS} AS words, coalesce(syllables, 0) AS syllables
  FROM art LEFT JOIN syl USING (seq)), a AS (
  SELECT *, sentences > 0 AND words > 0 AS ok,
    CASE WHEN sentences > 0 AND words > 0 THEN words::DOUBLE / sentences END AS avg_sentence_length,
    CASE WHEN sentences > 0 AND words > 0 THEN syllables::DOUBLE / words END AS avg_syllables_per_word FROM m), f AS (
  SELECT *, greatest(0.0::DOUBLE, least(100.0::DOUBLE, 206.835::DOUBLE - 1.015::DOUBLE * avg_sentence_length
    - 84.6::DOUBLE * avg_syllables_per_word)) AS fs FROM a)
SELECT seq, sentences, words, syllables, avg_sentence_length, avg_syllables_per_word,
  CASE WHEN ok THEN fs END AS flesch_score,
  CASE WHEN NOT ok THEN NULL WHEN fs >= 90 THEN 'Very Easy' WHEN fs >= 80 THEN 'Easy' WHEN fs >= 70 THEN 'Fairly Easy'
    WHEN fs >= 60 THEN 'Standard' WHEN fs >= 50 THEN 'Fairly Difficult' WHEN fs >= 30 THEN 'Difficult'
    ELSE 'Very Difficult' END AS reading_level,
  CASE WHEN NOT ok THEN 'Insufficient text for analysis' END AS error FROM f"""

_AW = words("concat(title, '. ', content)")
ORACLE["chunk_text"] = f"""WITH {ART}, w AS (SELECT seq, {_AW} AS w FROM art),
o AS (SELECT seq, w, unnest(range(0, len(w), 460)) AS i FROM w), s AS (SELECT seq, w, unnest(range(0, len(w), 358)) AS i FROM w)
SELECT seq, 'overlap' AS mode, i // 460 AS part, md5(array_to_string(w[i + 1:i + 510], ' ')) AS text FROM o
UNION ALL SELECT seq, 'side by side', i // 358, md5(array_to_string(w[i + 1:i + 358], ' ')) FROM s"""

_WEIGHT = "CASE lower(y) " + " ".join(f"WHEN '{w}' THEN {v}" for w, v in A.WEIGHTS.items()) + " ELSE 0 END"
ORACLE["model_chunks"] = f"""WITH {ART}, w AS (SELECT seq, {_AW} AS w FROM art),
p AS (SELECT seq, list_sum(list_transform(w[i + 1:i + 510], lambda y: {_WEIGHT}))::DOUBLE AS t
  FROM (SELECT seq, w, unnest(range(0, len(w), 460)) AS i FROM w)),
g AS (SELECT seq, (t / (abs(t) + 1) + 1) / 2 AS good FROM p),
s AS (SELECT seq, count(*) AS n, sum(good::DECIMAL(28, 12)) AS good, sum((1 - good)::DECIMAL(28, 12)) AS bad,
  sum(greatest(good, 1 - good)::DECIMAL(28, 12)) AS best FROM g GROUP BY seq)
SELECT seq, CASE WHEN bad >= good THEN 'negative' ELSE 'positive' END AS label, best::DOUBLE / n AS confidence, good::DOUBLE / n AS positive
FROM s"""

ORACLE["model_sentiment"] = f"""WITH {ART}, w AS (SELECT seq, len({_AW}) AS n FROM art)
SELECT seq, ((n + 459) // 460)::BIGINT AS n_parts, true AS known_label, true AS bounded, true AS adds_up, true AS agrees FROM w WHERE n > 0"""
ORACLE["model_batches"] = f"""WITH {ART}, w AS (SELECT seq, {_AW} AS w FROM art),
t AS (SELECT seq, contains(array_to_string(w, ' '), '#') AS bad, coalesce(list_sum(list_transform(w, lambda y: {_WEIGHT})), 0)::DOUBLE AS t FROM w),
g AS (SELECT seq, bad, (t / (abs(t) + 1) + 1) / 2 AS good FROM t)
SELECT seq, CASE WHEN bad THEN 'neutral' WHEN 1 - good >= good THEN 'negative' ELSE 'positive' END AS label,
  CASE WHEN bad THEN 0 ELSE greatest(good, 1 - good) END AS confidence, CASE WHEN NOT bad THEN good END AS positive,
  CASE WHEN bad THEN 'ValueError: cannot read this' END AS error FROM g"""

# --- sentiment ---------------------------------------------------------------------------------

# Word lists by checksum, as the query makes them.
_TERMS = f"""wd AS (
  SELECT DISTINCT trim(w, '{PUNCT}') AS w FROM (SELECT unnest(string_split(lower({collapse("text")}), ' ')) AS w FROM documents)),
tm AS (SELECT unnest([w, w || '-x', w || '-y']) AS term FROM wd WHERE w <> ''),
th AS (SELECT term, ('0x' || substr(md5(term), 1, 8))::BIGINT AS h FROM tm),
lex AS (SELECT term, CASE WHEN h % 2 = 0 THEN 1 ELSE -1 END * (h % 40 + 1) AS v FROM th WHERE h % 5 < 2),
pol AS (SELECT term, CASE WHEN h % 2 = 0 THEN 1 ELSE -1 END * (h % 101) AS p, h % 89 AS s FROM th WHERE h % 7 < 3),
boost AS (SELECT term, CASE WHEN h % 2 = 0 THEN 1 ELSE -1 END AS b FROM th WHERE h % 17 = 0),
neg AS (SELECT term FROM th WHERE h % 19 = 0)"""
ORACLE["lexicon_table"] = f"""WITH {_TERMS}, {ART}, {lexical()}, {polarity()}
SELECT seq, l.label, l.confidence, l.compound, p.label AS polar, p.polarity, p.subjectivity FROM lexd l JOIN pold p USING (seq)"""
ORACLE["lexicon_sentiment"] = f"""WITH {_LISTS}, {ART}, {lexical()}
SELECT seq, label, confidence, compound, pos AS positive, neg AS negative, neu AS neutral FROM lexd"""
ORACLE["lexicon_confidence"] = f"""WITH {_LISTS}, {lexical("conversations", "conv_id, turn", "role", "text")}
SELECT conv_id, turn, label, confidence, compound FROM lexd"""
ORACLE["polarity_sentiment"] = f"""WITH {_LISTS}, {ART}, {polarity()}
SELECT seq, label, confidence, polarity, subjectivity, greatest(0, polarity) AS positive,
  greatest(0, -polarity) AS negative, 1.0::DOUBLE - abs(polarity) AS neutral FROM pold"""
ORACLE["polarity_confidence"] = f"""WITH g AS (
  SELECT doc_id AS seq, (length(text) % 201 - 100)::DOUBLE / 100.0::DOUBLE AS polarity,
    (length(text) % 101)::DOUBLE / 100.0::DOUBLE AS subjectivity FROM documents)
SELECT seq, {POL_CONF} AS confidence FROM g"""
ORACLE["subjectivity_band"] = """SELECT CASE WHEN length(text) % 101 >= 80 THEN 'Very subjective (opinion-based)'
  WHEN length(text) % 101 >= 60 THEN 'Mostly subjective' WHEN length(text) % 101 >= 40 THEN 'Somewhat subjective'
  WHEN length(text) % 101 >= 20 THEN 'Mostly objective' ELSE 'Very objective (fact-based)' END AS band,
  count(*) AS n FROM documents GROUP BY 1"""
ORACLE["normalize_label"] = """WITH g AS (SELECT doc_id AS seq, length(text) % 41 - 20 AS x FROM documents)
SELECT seq, CASE WHEN x > 2 THEN 'positive' WHEN x < -2 THEN 'negative' ELSE 'neutral' END AS label,
  CASE WHEN x > 10 THEN 'positive' WHEN x < -5 THEN 'negative' ELSE 'neutral' END AS wide_label FROM g"""
ORACLE["map_model_labels"] = """WITH g AS (
  SELECT [concat('LABEL_', doc_id % 4), 'POS', upper(lang), 'very_bad', 'Goodish', 'Neg.', 'neutral', (doc_id % 5)::VARCHAR]
    [doc_id % 8 + 1] AS model_label FROM documents), m AS (
  SELECT model_label, CASE
    WHEN model_label IN ('LABEL_2', 'POS', '2', 'Goodish') THEN 'positive'
    WHEN model_label IN ('LABEL_0', 'Neg.', '0', 'very_bad') THEN 'negative' ELSE 'neutral' END AS label FROM g)
SELECT model_label, label, count(*) AS n FROM m GROUP BY ALL"""

_SENT_TXT = f"sx AS (SELECT seq, idx, s AS sentence, {collapse(chr(115))} AS txt FROM sent)"
ORACLE["sentence_polarity"] = f"""WITH {_LISTS}, {ART}, {_SENT}, {_SENT_TXT}, {polar("sx", "seq, idx", "txt", "sp")}
SELECT seq, idx, md5(sentence) AS sentence, polarity, subjectivity FROM sp JOIN sx USING (seq, idx)"""
ORACLE["document_polarity"] = f"""WITH {_LISTS}, {ART}, {_SENT}, {_SENT_TXT}, {polar("sx", "seq, idx", "txt", "sp")},
doc AS (SELECT seq, {collapse("content")} AS txt FROM art), {polar("doc", "seq", "txt", "dp")}, m AS (
  SELECT seq, count(*) AS n, list_reduce(list(polarity ORDER BY idx), lambda a, b: a + b) / count(*) AS mean FROM sp GROUP BY seq)
SELECT art.seq, coalesce(n, 0) AS n_sentences, {N_WORDS} AS n_words, polarity, subjectivity,
  coalesce(mean, 0) AS mean_sentence_polarity
FROM art JOIN dp USING (seq) LEFT JOIN m USING (seq)"""
ORACLE["margin_confidence"] = f"""WITH {_LISTS}, {ART}, {lexical()}, l AS (
  SELECT seq, pos, list_sort([pos, neg, neu], 'DESC') AS r FROM lexd)
SELECT seq, CASE seq % 10 WHEN 0 THEN pos WHEN 1 THEN 0 ELSE least(1, greatest(0, r[1] - r[2])) END AS confidence FROM l"""
ORACLE["ensemble_vote"] = f"""WITH {_LISTS}, {ART}, {lexical()}, {polarity()}, m AS (
  SELECT seq, len(regexp_extract_all(concat(title, '. ', content), '{A.MARKS}')) AS n FROM art), v AS (
  SELECT seq, a.label AS la, a.confidence AS ca, b.label AS lb, b.confidence AS cb,
    CASE WHEN n > 20 THEN 'negative' WHEN n > 0 THEN 'neutral' ELSE 'positive' END AS lm, 0.6::DOUBLE AS cm,
    compound, polarity, n
  FROM lexd a JOIN pold b USING (seq) JOIN m USING (seq)), w AS (
  SELECT *, CASE WHEN lb = lm AND la <> lb THEN lb ELSE la END AS label FROM v), x AS (
  SELECT *, (CASE WHEN la = label THEN 1 ELSE 0 END + CASE WHEN lb = label THEN 1 ELSE 0 END + CASE WHEN lm = label THEN 1 ELSE 0 END)
    / 3.0::DOUBLE AS share,
    (ca * CASE WHEN la = label THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END + cb * CASE WHEN lb = label THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END
      + cm * CASE WHEN lm = label THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) / (ca + cb + cm) AS conf FROM w)
SELECT seq, label, conf AS confidence, conf AS consensus_confidence, share AS analyzer_agreement,
  compound AS lexicon_compound, polarity AS polarity_polarity, n::DOUBLE AS marks_count FROM x"""
ORACLE["chunk_combine"] = f"""WITH {_LISTS}, {ART}, aw AS (SELECT seq, {_AW} AS w FROM art), part AS (
  SELECT seq, i // 80 AS part, array_to_string(w[i + 1:i + 100], ' ') AS txt
  FROM (SELECT seq, w, unnest(range(0, len(w), 80)) AS i FROM aw)),
{rule("part", "seq, part", "txt")}, m AS (
  SELECT seq, list_reduce(list(neg ORDER BY part), lambda a, b: a + b) / count(*) AS neg,
    list_reduce(list(neu ORDER BY part), lambda a, b: a + b) / count(*) AS neutral,
    list_reduce(list(pos ORDER BY part), lambda a, b: a + b) / count(*) AS pos,
    list_reduce(list(greatest(neg, neu, pos) ORDER BY part), lambda a, b: a + b) / count(*) AS confidence
  FROM rule GROUP BY seq)
SELECT seq, CASE WHEN neg >= neutral AND neg >= pos THEN 'negative' WHEN neutral >= pos THEN 'neutral' ELSE 'positive' END AS label,
  confidence, neg, neutral, pos FROM m"""

# --- sources -----------------------------------------------------------------------------------

_NEWSNUM = "CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER)"
ORACLE["ingest_rss"] = f"""WITH {ART}, it AS (
  SELECT seq, {clean("title")} AS t, {clean("content")} AS body, url, source, published_date, category FROM art
  WHERE seq % 17 <> 0), {top5("it", "seq", "body")}
SELECT seq AS guid, t AS title, md5(body) AS content, url,
  concat(upper(substr(source, 1, 1)), lower(substr(source, 2))) AS source,
  CASE WHEN seq % 9 = 0 THEN {AS_OF} ELSE published_date END AS published_date,
  CASE WHEN seq % 4 = 0 THEN concat('Author ', source) END AS author, md5(body) AS summary,
  CASE WHEN seq % 3 = 0 THEN concat(lower(category), '|', lower(source)) ELSE coalesce(keywords, '') END AS keywords,
  CASE WHEN seq % 3 = 0 THEN upper(category) END AS category
FROM it LEFT JOIN kw USING (seq) WHERE t <> ''"""
ORACLE["stream_ingest"] = ORACLE["ingest_rss"]
ORACLE["ingest_atom"] = ORACLE["ingest_rss"]

_API = f"""api AS (
  SELECT seq, {clean("title")} AS t, source, published_date, url,
    {clean("concat('About: ', content)")} AS descr,
    CASE WHEN seq % 7 = 0 OR seq % 5 = 0 THEN '' ELSE {clean("content")} END AS full_text
  FROM art WHERE seq % 13 <> 0 AND ({_NEWSNUM} + seq // 1000) % 7 <> 3), apx AS (
  SELECT *, CASE WHEN full_text = '' OR full_text LIKE '%[+' OR full_text LIKE '%...' THEN descr ELSE full_text END AS body
  FROM api WHERE t <> '')"""
ORACLE["ingest_api_json"] = f"""WITH {ART}, {_API}, {top5("apx", "seq", "CASE WHEN body = '' THEN descr ELSE body END")}
SELECT seq, t AS title, md5(body) AS content, url, CASE WHEN seq % 10 = 0 THEN 'Unknown' ELSE source END AS source,
  CASE WHEN seq % 11 IN (0, 1) THEN {AS_OF} ELSE published_date END AS published_date,
  CASE WHEN seq % 4 = 0 THEN concat('Author ', source) END AS author, md5(descr) AS summary,
  coalesce(keywords, '') AS keywords
FROM apx LEFT JOIN kw USING (seq)"""
_ITEMS = f"""itm AS (
  SELECT seq, {clean("title")} AS t, url, source, published_date,
    {clean("CASE WHEN seq % 4 <> 0 THEN content WHEN seq % 8 = 0 THEN concat('More ', content) ELSE '' END")} AS descr
  FROM art WHERE seq % 19 <> 0), itx AS (SELECT * FROM itm WHERE t <> '')"""
_ITEM_SOURCE = "CASE WHEN seq % 5 <> 0 THEN concat('Pub ', source) WHEN seq % 10 <> 0 THEN source ELSE 'Google News' END"
ORACLE["ingest_feed_items"] = f"""WITH {ART}, {_ITEMS}, {top5("itx", "seq", "concat(t, ' ', descr)")}
SELECT seq // 1000 AS batch, t AS title, md5(CASE WHEN descr = '' THEN t ELSE descr END) AS content, url,
  {_ITEM_SOURCE} AS source, CASE WHEN seq % 3 IN (0, 1) THEN published_date ELSE {AS_OF} END AS published_date,
  md5(descr) AS summary, coalesce(keywords, '') AS keywords FROM itx LEFT JOIN kw USING (seq)"""
ORACLE["union_sources"] = f"""WITH {ART}, {_API}, {_ITEMS}, u AS (
  SELECT 'rss' AS source_type, concat(upper(substr(source, 1, 1)), lower(substr(source, 2))) AS source FROM art
  WHERE seq % 17 <> 0 AND {clean("title")} <> ''
  UNION ALL SELECT 'api', CASE WHEN seq % 10 = 0 THEN 'Unknown' ELSE source END FROM apx
  UNION ALL SELECT 'api', {_ITEM_SOURCE} FROM itx)
SELECT source_type, source, count(*) AS n FROM u GROUP BY ALL"""
ORACLE["source_catalog"] = """WITH s AS (
  SELECT source, min(doc_id) AS m, count(*) AS n, arg_min(lang, doc_id) AS lang FROM documents GROUP BY source), r AS (
  SELECT source AS id, upper(source) AS name, n::VARCHAR AS description, concat('https://', source, '.example.com') AS url,
    ['business', 'science', 'general'][m % 3 + 1] AS category, lang AS language,
    CASE WHEN m % 2 = 0 THEN 'us' ELSE 'in' END AS country FROM s WHERE m % 10 <> 9)
SELECT 'all' AS rule, * FROM r UNION ALL SELECT 'some', * FROM r WHERE category = 'science' AND language = 'en'"""
_LOG = f"""WITH {ART}, b AS (
  SELECT source, seq // 1000 AS batch, count(*) FILTER (seq % 13 <> 0 AND {clean("title")} <> '') AS n,
    ({_NEWSNUM} + seq // 1000) % 7 = 3 AS failed
  FROM art GROUP BY ALL), l AS (
  SELECT source, 'api' AS source_type, NOT bool_or(failed) AS success,
    CASE WHEN bool_or(failed) THEN concat('News API error: limit of ', source) END AS error_message,
    {AS_OF} AS timestamp, sum(CASE WHEN failed THEN 0 ELSE n END)::BIGINT AS article_count FROM b GROUP BY source)"""
ORACLE["ingest_log_feeds"] = f"""WITH {ART}, b AS (
  SELECT source, seq // 1000 AS batch, count(*) FILTER (seq % 17 <> 0 AND {clean("title")} <> '') AS n,
    ({_NEWSNUM} + seq // 1000) % 7 = 3 AS failed
  FROM art GROUP BY ALL)
SELECT source, 'rss' AS source_type, NOT bool_or(failed) AS success,
  CASE WHEN bool_or(failed) THEN 'Feed error: not a feed' END AS error_message,
  {AS_OF} AS timestamp, sum(CASE WHEN failed THEN 0 ELSE n END)::BIGINT AS article_count FROM b GROUP BY source"""
ORACLE["ingest_capped"] = f"""WITH {ART}, i AS (
  SELECT *, row_number() OVER (PARTITION BY source, seq // 1000 ORDER BY seq) AS pos FROM art), k AS (
  SELECT {clean("title")} AS title, {clean("content")} AS body, url, pos,
    concat(upper(substr(source, 1, 1)), lower(substr(source, 2))) AS source
  FROM i WHERE seq % 17 <> 0), c AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY pos, url) AS n FROM k WHERE title <> '')
SELECT url, source, title FROM c WHERE n <= 20
  AND (contains(lower(concat(title, ' ', body)), 'est') OR contains(lower(concat(title, ' ', body)), 'the'))"""
ORACLE["ingest_log"] = f"{_LOG} SELECT * FROM l"
ORACLE["ingest_run_totals"] = f"""{_LOG} SELECT count(*) AS total_sources, count(*) FILTER (success) AS successful_sources,
  sum(article_count)::BIGINT AS total_articles FROM l"""

_HOST = "lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"


def site(url: str, extra: tuple[str, ...] = ()) -> str:
    h = _HOST.format(url)
    for prefix in ("www.", *extra):
        h = f"replace({h}, '{prefix}', '')"
    label = f"split_part({h}, '.', 1)"
    return f"concat(upper(substr({label}, 1, 1)), lower(substr({label}, 2)))"


_NO_COMMENT = "regexp_replace(html, '(?s)<!--.*?-->', '', 'g')"
_NO_SCRIPT = "regexp_replace({0}, '(?is)<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>', '', 'g')"


def node_text(tag: str) -> str:
    body = f"regexp_extract(h, '(?is)<{tag}\\b[^>]*>(.*?)</{tag}\\s*>', 1)"
    return clean(decode(_TAGS.format(_NO_SCRIPT.format(body))))


_PAGES = f"""pg AS (SELECT page_id, url, {_NO_COMMENT} AS h FROM {_TAILED}), tx AS (
  SELECT page_id, url, {node_text("h1")} AS h1, {node_text("title")} AS tt, {node_text("article")} AS body FROM pg), ok AS (
  SELECT page_id, url, CASE WHEN length(h1) > 10 THEN h1 WHEN length(tt) > 10 THEN tt END AS title, body FROM tx), good AS (
  SELECT * FROM ok WHERE title IS NOT NULL AND length(body) > 100)"""
ORACLE["extract_articles_html"] = f"""WITH {_PAGES}, {top5("good", "page_id", "body", 8)}
SELECT page_id, title, md5(body) AS content, url, {site("url")} AS source, {AS_OF} AS published_date,
  coalesce(keywords, '') AS keywords FROM good LEFT JOIN kw USING (page_id)"""
ORACLE["ingest_log_items"] = f"""WITH {ART}, {_PAGES}, b AS (
  SELECT source, seq // 1000 AS batch, count(*) FILTER (seq % 19 <> 0 AND {clean("title")} <> '') AS n, ({_NEWSNUM} + seq // 1000) % 7 = 3 AS failed
  FROM art GROUP BY ALL), w AS (SELECT {site("p.url")} AS source, g.page_id IS NULL AS failed FROM pages p LEFT JOIN good g USING (page_id))
SELECT source, 'api' AS source_type, NOT bool_or(failed) AS success,
  CASE WHEN bool_or(failed) THEN 'Aggregator error: no list of items' END AS error_message,
  {AS_OF} AS timestamp, sum(CASE WHEN failed THEN 0 ELSE n END)::BIGINT AS article_count FROM b GROUP BY source
UNION ALL SELECT source, 'website', NOT bool_or(failed), CASE WHEN bool_or(failed) THEN 'Page error: no article' END, {AS_OF},
  count(*) FILTER (NOT failed) FROM w GROUP BY source"""
ORACLE["extract_articles_dom"] = f"WITH {_PAGES} SELECT page_id, title, md5(body) AS content FROM good"
_KNOWN = "regexp_matches(url, '//[^/]*[.](org|net)(/|$)')"
ORACLE["site_selectors"] = f"""WITH pg AS (SELECT page_id, url, {_NO_COMMENT} AS h FROM {_TAILED}), tx AS (
  SELECT page_id, {_KNOWN} AS own, {node_text("h1")} AS h1, {node_text("title")} AS tt, {node_text("article")} AS body, {node_text("footer")} AS foot FROM pg), ok AS (
  SELECT page_id, CASE WHEN own AND length(tt) > 10 THEN tt WHEN length(h1) > 10 THEN h1 WHEN length(tt) > 10 THEN tt END AS title,
    CASE WHEN own AND length(foot) > 100 THEN foot ELSE body END AS body FROM tx)
SELECT page_id, title, md5(body) AS content FROM ok WHERE title IS NOT NULL AND length(body) > 100"""
ORACLE["site_links"] = f"""WITH n AS (
  SELECT page_id, url, regexp_extract({_NO_COMMENT}, '(?s)<nav>.*?</nav>') AS h FROM pages WHERE {_KNOWN}), l AS (
  SELECT page_id, url, unnest(regexp_extract_all(h, '<a href="([^"]*)"', 1)) AS href,
    generate_subscripts(regexp_extract_all(h, '<a href="([^"]*)"', 1), 1) AS o FROM n), r AS (
  SELECT page_id, concat(regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1), {decode("href")}) AS link, o FROM l), f AS (
  SELECT page_id, link, min(o) AS o FROM r WHERE NOT regexp_matches(link,
  '(?i)/tag/|/category/|/author/|/page/|/search/|/archive/|/contact/|/about/|\\.pdf$|\\.jpg$|\\.png$|\\.gif$|#|mailto:|javascript:')
  GROUP BY ALL)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY o) - 1 AS pos, link FROM f"""
ORACLE["extract_links"] = f"""WITH l AS (
  SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href,
    generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) AS o FROM pages), r AS (
  SELECT page_id, concat(regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1), {decode("href")}) AS link, o FROM l), f AS (
  SELECT page_id, link, min(o) AS o FROM r WHERE NOT regexp_matches(link,
  '(?i)/tag/|/category/|/author/|/page/|/search/|/archive/|/contact/|/about/|\\.pdf$|\\.jpg$|\\.png$|\\.gif$|#|mailto:|javascript:')
  GROUP BY ALL)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY o) - 1 AS pos, link FROM f"""
ORACLE["follow_links"] = f"""WITH {ART}, p AS (
  SELECT seq, source, published_date, {clean("title")} AS h1, {clean("concat(title, content)")} AS body FROM art), good AS (
  SELECT * FROM p WHERE length(h1) > 10 AND length(body) > 100), {top5("good", "seq", "body", 8)}
SELECT seq, h1 AS title, md5(body) AS content, concat('https://www.daily.example.org/article/', seq) AS url, 'Daily' AS source,
  published_date, concat('By ', source) AS author, concat('about ', source) AS summary, coalesce(keywords, '') AS keywords
FROM good LEFT JOIN kw USING (seq)"""
ORACLE["source_name_from_url"] = f"""WITH p AS (
  SELECT page_id, url, concat('http://www.feeds.', regexp_extract(url, '//(.*)', 1)) AS feed FROM pages)
SELECT page_id, {site("url")} AS site, {site("feed")} AS feed_as_site, {site("feed", ("feeds.", "rss."))} AS feed FROM p"""
ORACLE["parse_dates"] = f"""WITH {ART} SELECT seq, CASE WHEN seq % 15 IN (6, 7) THEN {AS_OF}
  WHEN seq % 15 = 2 THEN published_date - INTERVAL 2 HOUR WHEN seq % 15 = 9 THEN published_date + INTERVAL 5 HOUR
  WHEN seq % 15 IN (3, 4, 5, 12, 13) THEN date_trunc('day', published_date) ELSE published_date END AS parsed,
  seq % 15 NOT IN (6, 7) AS is_date FROM art"""

# --- store -------------------------------------------------------------------------------------

_OUT = "url, seq, source, sentiment_label, sentiment_confidence, word_count, reading_time, created_at, updated_at"
ORACLE["stored_rows"] = f"""WITH {_LISTS}, {ART}, {lexical()}
SELECT seq, url, label AS sentiment_label, confidence AS sentiment_confidence, 'lexicon' AS sentiment_model,
  {N_WORDS} AS word_count, greatest(1, {N_WORDS} // 200) AS reading_time, 4 AS n_scores, 0 AS n_metadata, {AS_OF} AS created_at
FROM art JOIN lexd USING (seq)"""
ORACLE["stored_roundtrip"] = f"""{STORED}
SELECT seq, url, sentiment_label AS label, sentiment_confidence AS confidence,
  CASE WHEN sentiment_label IS NOT NULL THEN 'lexicon' END AS model_used, 0 AS n_keywords, 0 AS n_metadata, md5(content) AS content FROM st"""
_TWO = f"""WITH {_LISTS}, {ART}, {lexical()}, {stored("category <> 'fr'", "a")}"""
_NEW = f"""new AS (
  SELECT art.*, label, confidence, published_date + INTERVAL 7 DAY AS saved FROM art JOIN lexd USING (seq) WHERE category <> 'en'
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq DESC) = 1)"""
ORACLE["upsert_articles"] = f"""{_TWO}, {_NEW}
SELECT n.url, n.seq, n.source, n.label AS sentiment_label, n.confidence AS sentiment_confidence, {N_WORDS.replace("content", "n.content")} AS word_count,
  greatest(1, {N_WORDS.replace("content", "n.content")} // 200) AS reading_time, coalesce(a.created_at, n.saved) AS created_at, n.saved AS updated_at
FROM new n LEFT JOIN a USING (url)
UNION ALL SELECT {_OUT} FROM a WHERE url NOT IN (SELECT url FROM new)"""
ORACLE["migrate_counts"] = f"""WITH {ART}, a AS (SELECT DISTINCT url FROM art WHERE category <> 'fr'),
b AS (SELECT DISTINCT url FROM art WHERE category <> 'en')
SELECT count(*) AS saved, count(*) AS urls, count(*) FILTER (a.url IS NULL) AS inserted, count(a.url) AS updated,
  (SELECT count(*) FROM (SELECT url FROM a UNION SELECT url FROM b)) AS total
FROM b LEFT JOIN a USING (url)"""
_SAVED = "url, seq, source, sentiment_label, sentiment_confidence, word_count, reading_time"
ORACLE["migrated_store"] = f"""WITH {_LISTS}, {ART}, {lexical()}, {stored("category <> 'fr'", "a")}, {stored("category <> 'en'", "b")}
SELECT {", ".join("b." + x.strip() for x in _SAVED.split(","))}, coalesce(a.created_at, b.created_at) AS created_at, b.updated_at
FROM b LEFT JOIN a USING (url)
UNION ALL SELECT {_SAVED}, created_at, updated_at FROM a WHERE url NOT IN (SELECT url FROM b)"""
ORACLE["retention_purge"] = f"""{STORED}
SELECT source, count(*) FILTER (scraped_date < {AS_OF} - INTERVAL 30 DAY) AS deleted,
  count(*) FILTER (scraped_date >= {AS_OF} - INTERVAL 30 DAY) AS kept FROM st GROUP BY source"""
_LATER = "TIMESTAMP '2025-01-01 00:00:00'"
_HIT = "(content LIKE '%est%' OR title LIKE '%est%' OR content LIKE '%the%' OR title LIKE '%the%')"
_RESCORE = """SELECT url, st.seq, source, CASE WHEN {0} THEN label ELSE sentiment_label END AS sentiment_label,
  CASE WHEN {0} THEN confidence ELSE sentiment_confidence END AS sentiment_confidence, word_count, reading_time, created_at,
  CASE WHEN {0} THEN {1} ELSE updated_at END AS updated_at FROM st JOIN pold USING (seq)"""
ORACLE["reanalyze_stored"] = f"{STORED}, {polarity()} " + _RESCORE.format(_HIT, _LATER)
ORACLE["reanalyze_newest"] = (
    f"{STORED}, {polarity()}, newest AS (SELECT url FROM st ORDER BY published_date DESC, url LIMIT 40) "
    + _RESCORE.format("url IN (SELECT url FROM newest)", _LATER)
)

# --- files -------------------------------------------------------------------------------------

_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S')"
ORACLE["export_csv_projection"] = f"""WITH {_LISTS}, {ART}, {lexical()}, {top5("art", "seq", "content")}
SELECT title, url, source, {_ISO.format("published_date")} AS published_date, {_ISO.format("scraped_date")} AS scraped_date,
  '' AS author, '' AS summary, md5(content) AS content, replace(coalesce(keywords, ''), '|', ', ') AS keywords, category,
  source_type, label AS sentiment_label, confidence::VARCHAR AS sentiment_confidence
FROM art JOIN lexd USING (seq) LEFT JOIN kw USING (seq)"""
ORACLE["export_head"] = f"""WITH {ART} SELECT title, url, source, {_ISO.format("published_date")} AS published_date
FROM art ORDER BY published_date DESC, seq LIMIT 200"""
ORACLE["report_projection"] = f"""WITH {_LISTS}, {ART}, {lexical()}
SELECT title, url, source, published_date, scraped_date, '' AS author, '' AS summary, '' AS keywords, category, source_type,
  label AS sentiment_label, confidence AS sentiment_confidence, {N_WORDS} AS word_count,
  greatest(1, {N_WORDS} // 200) AS reading_time FROM art JOIN lexd USING (seq)"""
ORACLE["article_json_codec"] = f"""WITH {_LISTS}, {ART}, {lexical()}
SELECT seq, title, md5(content) AS content, url, source, published_date, scraped_date, NULL::VARCHAR AS author, category,
  source_type, label, confidence, 0 AS n_keywords FROM art JOIN lexd USING (seq)"""
ORACLE["json_roundtrip"] = f"""WITH {_LISTS}, {ART}, {lexical()}, {top5("art", "seq", "content")}
SELECT title, md5(content) AS content, url, source, published_date, scraped_date, coalesce(keywords, '') AS keywords, category,
  source_type, label, confidence FROM art JOIN lexd USING (seq) LEFT JOIN kw USING (seq)"""
ORACLE["csv_roundtrip"] = ORACLE["json_roundtrip"]

ORACLE["json_envelope_import"] = f"""WITH {_LISTS}, {ART}, {lexical()}
SELECT title, md5(content) AS content, url, source, published_date, scraped_date, category, source_type, label, confidence
FROM art JOIN lexd USING (seq)"""
ORACLE["import_quarantine"] = f"""WITH {ART}
SELECT strftime(scraped_date, '%Y-%m-%dT%H:%M:%S') AS scraped_date, category,
  CASE seq % 10 WHEN 1 THEN 'no title' WHEN 2 THEN 'no url' WHEN 3 THEN 'unknown source type' ELSE 'unknown sentiment label' END AS problem
FROM art WHERE seq % 10 BETWEEN 1 AND 4"""

ORACLE["report_tables"] = f"""WITH {_LISTS}, {ART}, {lexical()}, r AS (
  SELECT url, source, md5(content) AS text, CASE WHEN seq % 5 <> 4 THEN label END AS label, CASE WHEN seq % 5 <> 4 THEN confidence END AS confidence
  FROM art JOIN lexd USING (seq)), n AS (SELECT count(*) AS n FROM r), s AS (
  SELECT count(*) AS total, count(label) AS analyzed, count(DISTINCT source) AS sources, {MEAN.format("confidence")} AS conf FROM r),
m AS (
  SELECT 'Total Articles' AS metric, total::DOUBLE AS value FROM s UNION ALL SELECT 'Analyzed Articles', analyzed FROM s
  UNION ALL SELECT 'Analysis Coverage', analyzed::DOUBLE / total * 100 FROM s
  UNION ALL SELECT concat(upper(label[1]), label[2:], ' Sentiment'), count(*) FROM r WHERE label IS NOT NULL GROUP BY label
  UNION ALL SELECT concat(upper(label[1]), label[2:], ' Sentiment Percent'), count(*)::DOUBLE / any_value(analyzed) * 100 FROM r, s WHERE label IS NOT NULL GROUP BY label
  UNION ALL SELECT 'Average Confidence', conf FROM s UNION ALL SELECT 'Number of Sources', sources FROM s)
SELECT 'articles' AS sheet, url AS name, text, coalesce(label, '') AS sentiment_label, confidence AS value, n AS written FROM r, n
UNION ALL SELECT 'summary', metric, NULL, NULL, value, n FROM m, n"""
# Two runs over halves of the documents: even numbers, then odd ones.
_RUNS = f"""{_LISTS}, {ART}, {TIDY}, {lexical('tidy')}, runs AS (
  SELECT t.*, label, seq % 2 AS run FROM tidy t JOIN lexd USING (seq)
  QUALIFY row_number() OVER (PARTITION BY url, run ORDER BY seq) = 1), st AS (
  SELECT *, min(run) OVER (PARTITION BY url) AS born FROM runs QUALIFY row_number() OVER (PARTITION BY url ORDER BY run DESC) = 1)"""
ORACLE["full_pipeline"] = f"""WITH {_RUNS}, second AS (
  SELECT count(*) AS saved, count(*) FILTER (born = 1) AS inserted, count(*) FILTER (born = 0) AS updated FROM st WHERE run = 1)
SELECT 'store' AS part, url AS key, concat(label, ' 2024-04-01') AS label, seq AS n FROM st
UNION ALL SELECT 'export', url, label, length(content) FROM st
UNION ALL SELECT 'log', concat(CASE seq % 2 WHEN 0 THEN 'one' ELSE 'two' END, ' ', source), 'true', count(*) FROM art GROUP BY ALL
UNION ALL SELECT 'counts', k, 'two', n FROM (
  SELECT unnest(['saved', 'urls', 'inserted', 'updated', 'total', 'exported']) AS k,
    unnest([saved, saved, inserted, updated, (SELECT count(*) FROM st), (SELECT count(*) FROM st)]) AS n FROM second)"""
ORACLE["run_dump"] = f"""WITH {_RUNS}, log AS (SELECT source, count(*) AS n FROM art WHERE seq % 2 = 1 GROUP BY source)
SELECT log.source, true AS success, n AS article_count, url, title, md5(content) AS content, label
FROM log LEFT JOIN (SELECT * FROM runs WHERE run = 1) r USING (source)"""

# --- streams -----------------------------------------------------------------------------------

ORACLE["stream_dedup"] = f"""WITH {ART} SELECT url, source, seq FROM art
QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq % 3, seq) = 1"""
ORACLE["stream_upsert"] = f"""WITH {ART}, batches AS (
  SELECT url, seq, seq % 3 AS batch, source, {N_WORDS} AS word_count, published_date FROM art
  QUALIFY row_number() OVER (PARTITION BY url, batch ORDER BY seq DESC) = 1)
SELECT url, seq, source, word_count, first_value(published_date) OVER (PARTITION BY url ORDER BY batch) AS created_at,
  published_date AS updated_at
FROM batches QUALIFY row_number() OVER (PARTITION BY url ORDER BY batch DESC) = 1"""
ORACLE["stream_sentiment_counts"] = f"""WITH {_LISTS}, {ART}, {lexical()}
SELECT date_trunc('day', published_date) AS window_start, label, count(*) AS n FROM art JOIN lexd USING (seq) GROUP BY ALL"""


# --- column types ------------------------------------------------------------------------------

# Counters that Spark keeps as 32-bit integers.
_INTEGERS = {
    "word_reading_stats": ("word_count", "reading_time"),
    "keywords_tfidf": ("rank", "n"),
    "keywords_frequency": ("rank", "n"),
    "readability": ("sentences", "words", "syllables"),
    "chunk_text": ("part",),
    "sentence_polarity": ("idx",),
    "document_polarity": ("n_sentences", "n_words"),
    "extract_links": ("pos",),
    "stored_rows": ("word_count", "reading_time"),
    "upsert_articles": ("word_count", "reading_time"),
    "report_projection": ("word_count", "reading_time"),
    "stream_upsert": ("word_count",),
}
for _name, _columns in _INTEGERS.items():
    _casts = ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in _columns)
    ORACLE[_name] = f"SELECT * REPLACE ({_casts}) FROM ({ORACLE[_name]})"
