"""Text, retrieval and page structure."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.text import STOPWORDS, product_key, rounded, sentences, tokens
from lodestone.functions.urls import host, segment_score
from lodestone.operators.retrieval import bm25_scores, lexical_scores, nearest
from lodestone.operators.series import top_k
from lodestone.session import table

SQL: dict[str, str] = {}
C = F.col
_STOP = "[" + ",".join(f"'{w}'" for w in STOPWORDS) + "]"
#: The words of a text in DuckDB.
_TOKENS = "list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9][a-z0-9''\\-.]*'), lambda w: length(w) > 2 AND NOT list_contains(" + _STOP + ", w))"


def token_counts(spark, d):
    t = tokens(C("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


SQL["token_counts"] = f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct FROM (SELECT doc_id, {_TOKENS.format('text')} AS t FROM documents)"


def vocabulary(spark, d):
    """Document and corpus frequency of every word."""
    t = table(spark, d, "documents").select("doc_id", F.explode(tokens(C("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    return t.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


SQL["vocabulary"] = f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS.format('text')}) AS term FROM documents) GROUP BY doc_id, term) GROUP BY term"


def sentence_counts(spark, d):
    s = sentences(C("text"))
    return table(spark, d, "documents").select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.coalesce(F.array_max(F.transform(s, lambda x: F.length(x))), F.lit(0)).cast("long").alias("longest"))


SQL["sentence_counts"] = r"""SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, CAST(coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS BIGINT) AS longest FROM
(SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE string_split(regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)) END AS s FROM documents)"""


def _runs(spark, d):
    return table(spark, d, "research_runs").where("question is not null").select("run_id", "question")


def _sections(spark, d, *fields):
    return table(spark, d, "research_sections").select("id", F.concat_ws(" ", *fields).alias("text"))


def lexical_topk(spark, d):
    """The five best sections of all for every run's question, by capped word hits in title, heading and content."""
    s = lexical_scores(_sections(spark, d, "title", "heading", "content"), "id", "text", _runs(spark, d), "run_id", "question")
    return top_k(s, ["query"], [F.desc("score"), C("doc")], 5).select("query", "doc", "score", C("rank").cast("long").alias("rank"))


_POSTINGS, _BM25_POSTINGS = (f"SELECT id AS doc, term, count(*) AS tf, any_value(n) AS len FROM (SELECT id, len(t) AS n, unnest(t) AS term FROM (SELECT id, {_TOKENS.format(x)} AS t FROM research_sections)) GROUP BY id, term" for x in ("concat_ws(' ', title, heading, content)", "concat_ws(' ', title, heading, url, content)"))
_TERMS = f"SELECT run_id AS query, len(t) AS n, unnest(t) AS term FROM (SELECT run_id, list_distinct({_TOKENS.format('question')}) AS t FROM research_runs WHERE question IS NOT NULL)"
SQL["lexical_topk"] = f"""SELECT query, doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM
(SELECT query, doc, least(1.0, floor((0.75 * sum(least(tf, 5)) / any_value(q.n) + 2.5 * sum(least(tf, 5)) / any_value(len)) * 10000 + 0.5) / 10000) AS score FROM ({_POSTINGS}) p JOIN ({_TERMS}) q USING (term) GROUP BY query, doc)) WHERE rank <= 5"""


def bm25_topk(spark, d):
    """The five best sections of all for every run's question, by BM25 over title, heading, url and content; scores to four places."""
    s = bm25_scores(_sections(spark, d, "title", "heading", "url", "content"), "id", "text", _runs(spark, d), "run_id", "question").withColumn("score", rounded(C("score")))
    return top_k(s, ["query"], [F.desc("score"), C("doc")], 5).select("query", "doc", "score", C("rank").cast("long").alias("rank"))


SQL["bm25_topk"] = f"""WITH p AS ({_BM25_POSTINGS}), q AS ({_TERMS}), df AS (SELECT term, count(*) AS df FROM p GROUP BY term), st AS (SELECT avg(len) AS al, (SELECT count(*) FROM research_sections) AS nd FROM (SELECT DISTINCT doc, len FROM p))
SELECT query, doc, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM
(SELECT query, doc, floor(sum(greatest(ln((nd - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al))) * 10000 + 0.5) / 10000 AS score FROM p JOIN q USING (term) JOIN df USING (term), st GROUP BY query, doc)) WHERE rank <= 5"""


def vector_topk(spark, d):
    """Ten nearest rows by cosine for every row whose id is divisible by 20, against all rows; similarity to four places."""
    v = table(spark, d, "embeddings")
    return nearest(v, "vec_id", "embedding", v.where("vec_id % 20 = 0"), 10).select("query", "neighbour", rounded(C("similarity")).alias("similarity"))


SQL["vector_topk"] = """SELECT query, neighbour, floor(s * 10000 + 0.5) / 10000 AS similarity FROM (SELECT a.vec_id AS query, b.vec_id AS neighbour, s, row_number() OVER (PARTITION BY a.vec_id ORDER BY s DESC, b.vec_id) AS k FROM embeddings a, embeddings b,
LATERAL (SELECT list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s) WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) WHERE k <= 10"""


def term_coverage(spark, d):
    """Share of a run's question words that any of its sections holds."""
    q = _runs(spark, d).select("run_id", F.explode(F.array_distinct(tokens(C("question")))).alias("term"))
    s = table(spark, d, "research_sections").select("run_id", F.explode(F.array_distinct(tokens(C("content")))).alias("term")).distinct().withColumn("hit", F.lit(1))
    return q.join(s, ["run_id", "term"], "left").groupBy("run_id").agg(F.count("*").alias("terms"), F.count("hit").alias("covered"))


SQL["term_coverage"] = f"""SELECT q.run_id, count(*) AS terms, count(s.term) AS covered FROM (SELECT run_id, unnest(list_distinct({_TOKENS.format('question')})) AS term FROM research_runs WHERE question IS NOT NULL) q
LEFT JOIN (SELECT DISTINCT run_id, unnest({_TOKENS.format('content')}) AS term FROM research_sections) s ON q.run_id = s.run_id AND q.term = s.term GROUP BY q.run_id"""

#: Words of complaint and of praise.
COMPLAINTS = ("bulky", "frustrating", "slow", "expensive", "short", "breaks", "loud", "delay")
PRAISE = ("amazing", "superb", "great", "comfortable", "excellent", "love", "perfect", "fast")


def keyword_sentiment(spark, d):
    """How many reviews of each region hold a term of praise or complaint, anywhere in a word."""
    text = F.lower(F.coalesce("review_text", F.lit("")))
    terms = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(k).alias("kind")) for k, ts in (("complaint", COMPLAINTS), ("praise", PRAISE)) for t in ts])
    hits = table(spark, d, "reviews").select("region", F.explode(F.filter(terms, lambda t: F.contains(text, t.term))).alias("t"))
    return hits.groupBy("region", "t.kind", "t.term").agg(F.count("*").alias("reviews"))


SQL["keyword_sentiment"] = "SELECT region, kind, term, count(*) AS reviews FROM reviews, (VALUES " + ",".join(f"('{k}','{t}')" for k, ts in (("complaint", COMPLAINTS), ("praise", PRAISE)) for t in ts) + ") v(kind, term) WHERE contains(lower(coalesce(review_text, '')), term) GROUP BY region, kind, term"


def review_search(spark, d):
    """Reviews by how many words of their product's name the text holds; those with any."""
    words = F.array_distinct(F.filter(F.split(product_key(C("product_name")), " "), lambda w: F.length(w) > 2))
    text = F.lower(F.coalesce("review_text", F.lit("")))
    r = table(spark, d, "reviews").where("product_name is not null").select("id", "scraped_at", F.size(F.filter(words, lambda w: F.contains(text, w))).cast("long").alias("hits"))
    return r.where("hits >= 1")


_WORDS = "list_distinct(list_filter(list_transform(regexp_extract_all(lower(product_name), '[a-z0-9]+'), lambda w: CASE w WHEN 'headset' THEN 'headphones' WHEN 'earphone' THEN 'headphones' ELSE w END), lambda w: length(w) > 2 AND NOT list_contains(['with','the','and','series','edition','new','plus','model'], w)))"
SQL["review_search"] = f"SELECT id, scraped_at, hits FROM (SELECT id, scraped_at, CAST(len(list_filter({_WORDS}, lambda w: contains(lower(coalesce(review_text, '')), w))) AS BIGINT) AS hits FROM reviews WHERE product_name IS NOT NULL) WHERE hits >= 1"

#: Path segments that promise much or little.
SIGNALS = {"pricing": 3.0, "product": 3.0, "review": 3.0, "compare": 3.0, "guide": 2.0, "blog": 2.0, "news": 2.0, "careers": -4.0, "press": -4.0, "privacy": -4.0, "terms": -4.0}


def frontier_rank(spark, d):
    """Pages of each run by the promise of their path, then depth and id; the 24 best (the limit is the feature)."""
    p = table(spark, d, "research_pages").select("run_id", "id", "depth", rounded(segment_score(C("url"), SIGNALS), 2).alias("score"))
    return top_k(p, ["run_id"], [F.desc("score"), C("depth"), C("id")], 24).select("run_id", "id", "score", C("rank").cast("long").alias("rank"))


_SCORE = " + ".join(f"CASE WHEN list_contains(s, '{k}') THEN {w} ELSE 0.0 END" for k, w in SIGNALS.items())
SQL["frontier_rank"] = f"""SELECT run_id, id, score, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, depth, id) AS k FROM (SELECT run_id, id, depth, floor((CAST({_SCORE} AS DOUBLE) - CAST(0.4 AS DOUBLE) * len(s)) * 100 + 0.5) / 100 AS score
FROM (SELECT *, list_filter(string_split(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1)), '/'), lambda x: x <> '') AS s FROM research_pages))) WHERE k <= 24"""


def page_relevance(spark, d):
    """Share of a run's question words found in the page, as words, over all pages of the run: a join on run and word."""
    q = _runs(spark, d).select("run_id", F.explode(F.array_distinct(tokens(C("question")))).alias("term"))
    p = table(spark, d, "research_pages").where("text <> ''").select("run_id", "id", F.explode(F.array_distinct(tokens(F.concat_ws(" ", "title", "text")))).alias("term"))
    n = q.groupBy("run_id").agg(F.count("*").alias("n"))
    return p.join(q, ["run_id", "term"]).groupBy("run_id", "id").agg(F.count("*").alias("hits")).join(n, "run_id").select("run_id", "id", "hits", rounded(C("hits") / C("n"), 3).alias("relevance"))


SQL["page_relevance"] = f"""WITH q AS (SELECT run_id, unnest(list_distinct({_TOKENS.format('question')})) AS term FROM research_runs WHERE question IS NOT NULL),
p AS (SELECT run_id, id, unnest(list_distinct({_TOKENS.format("concat_ws(' ', title, text)")})) AS term FROM research_pages WHERE text <> '')
SELECT p.run_id, id, count(*) AS hits, floor(CAST(count(*) AS DOUBLE) / any_value(n) * 1000 + 0.5) / 1000 AS relevance FROM p JOIN q ON p.run_id = q.run_id AND p.term = q.term JOIN (SELECT run_id, count(*) AS n FROM q GROUP BY run_id) c ON c.run_id = p.run_id GROUP BY p.run_id, id"""


def page_links(spark, d):
    """Links between hosts: edges of the link graph with their number."""
    found = F.regexp_extract_all(C("text"), F.lit(r"\]\((https?://[^)\s]+)\)"), F.lit(1))
    links = table(spark, d, "research_pages").where("text <> ''").select(host(C("url")).alias("from_host"), F.explode(found).alias("link"))
    return links.groupBy("from_host", host(C("link")).alias("to_host")).agg(F.count("*").alias("links"))


_H = r"regexp_replace(lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '^www\.', '')"
SQL["page_links"] = f"""SELECT {_H.format('url')} AS from_host, {_H.format('link')} AS to_host, count(*) AS links FROM (SELECT url, unnest(regexp_extract_all(text, '\\]\\((https?://[^)\\s]+)\\)', 1)) AS link FROM research_pages WHERE text <> '') GROUP BY 1, 2"""


def heading_sections(spark, d):
    """Captures cut at their headings: lines exploded, a running count of headings names the section."""
    lines = table(spark, d, "raw_evidence").where("content <> ''").select("id", F.posexplode(F.split(F.replace("content", F.lit("\r"), F.lit("")), "\n")).alias("n", "line"))
    w = W.partitionBy("id").orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow)
    numbered = lines.withColumn("section", F.sum(F.when(C("line").rlike("^#{1,6} "), 1).otherwise(0)).over(w))
    return numbered.groupBy("id", "section").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"), F.max(F.when(C("line").rlike("^#{1,6} "), F.regexp_replace("line", "^#+ ", ""))).alias("heading"))


SQL["heading_sections"] = """SELECT id, CAST(section AS BIGINT) AS section, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars, max(CASE WHEN regexp_matches(line, '^#{1,6} ') THEN regexp_replace(line, '^#+ ', '') END) AS heading FROM
(SELECT id, line, sum(CASE WHEN regexp_matches(line, '^#{1,6} ') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY n ROWS UNBOUNDED PRECEDING) AS section FROM
(SELECT id, unnest(l) AS line, generate_subscripts(l, 1) AS n FROM (SELECT id, string_split(replace(content, chr(13), ''), chr(10)) AS l FROM raw_evidence WHERE content <> ''))) GROUP BY id, section"""


def label_fields(spark, d):
    """Label lines of captures (Brand: x) as fields, first of each name."""
    line = F.regexp_extract_all(C("content"), F.lit(r"(?m)^([A-Z][A-Za-z ]{2,14}): \S.*$"), F.lit(1))
    names = table(spark, d, "raw_evidence").where("content <> ''").select("id", F.explode(F.array_distinct(line)).alias("name"))
    return names.groupBy("name").agg(F.count("*").alias("captures"))


SQL["label_fields"] = r"""SELECT name, count(*) AS captures FROM (SELECT id, unnest(list_distinct(regexp_extract_all(content, '(?m)^([A-Z][A-Za-z ]{2,14}): \S.*$', 1))) AS name FROM raw_evidence WHERE content <> '') GROUP BY name"""


def passage_overlap(spark, d):
    """Neighbouring sections of a page with at least a tenth of the smaller one's words in common."""
    w = W.partitionBy("page_id").orderBy("section_index", "id")
    s = table(spark, d, "research_sections").select("page_id", "id", F.array_distinct(tokens(C("content"))).alias("t"), F.lead("id").over(w).alias("next_id"), F.lead(F.array_distinct(tokens(C("content")))).over(w).alias("u"))
    s = s.where(C("next_id").isNotNull() & (F.size("t") > 0) & (F.size("u") > 0))
    share = F.size(F.array_intersect("t", "u")) / F.least(F.size("t"), F.size("u"))
    return s.select("id", "next_id", rounded(share, 3).alias("overlap")).where("overlap >= 0.1")


SQL["passage_overlap"] = f"""SELECT id, next_id, overlap FROM (SELECT id, next_id, floor(CAST(len(list_intersect(t, u)) AS DOUBLE) / least(len(t), len(u)) * 1000 + 0.5) / 1000 AS overlap FROM
(SELECT id, t, lead(id) OVER w AS next_id, lead(t) OVER w AS u FROM (SELECT page_id, section_index, id, list_distinct({_TOKENS.format('content')}) AS t FROM research_sections) WINDOW w AS (PARTITION BY page_id ORDER BY section_index, id))
WHERE next_id IS NOT NULL AND len(t) > 0 AND len(u) > 0) WHERE overlap >= 0.1"""


def stated_amounts(spark, d):
    """Offers whose title holds their exact amount in digits."""
    amounts = F.transform(F.regexp_extract_all(F.coalesce("listing_title", F.lit("")), F.lit(r"(\d+\.\d{2})(?!\d)"), F.lit(1)), lambda x: x.cast("decimal(18,2)"))
    o = table(spark, d, "offers").where("price is not null").select("id", F.array_contains(amounts, C("price").cast("decimal(18,2)")).alias("stated"))
    return o.where("stated").select("id")


SQL["stated_amounts"] = r"""SELECT id FROM offers WHERE price IS NOT NULL AND list_contains(list_transform(regexp_extract_all(coalesce(regexp_replace(listing_title, '(\d+\.\d{2})\d', 'x', 'g'), ''), '\d+\.\d{2}'), lambda x: CAST(x AS DECIMAL(18,2))), CAST(price AS DECIMAL(18,2)))"""



def amounts_in_sections(spark, d):
    """Amounts with a currency sign in every section: how many, and how many different."""
    found = F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(r"([$£€₹¥] ?\d[\d,]*(?:\.\d+)?)"), F.lit(1))
    return table(spark, d, "research_sections").select("id", F.size(found).cast("long").alias("amounts"), F.size(F.array_distinct(found)).cast("long").alias("distinct_amounts"))


SQL["amounts_in_sections"] = r"""SELECT id, CAST(len(a) AS BIGINT) AS amounts, CAST(len(list_distinct(a)) AS BIGINT) AS distinct_amounts FROM (SELECT id, regexp_extract_all(coalesce(content, ''), '[$£€₹¥] ?\d[\d,]*(?:\.\d+)?') AS a FROM research_sections)"""


def statement_roundtrip(spark, d):
    """Offers written as statements and parsed back; the rows that come back as they were."""
    o = table(spark, d, "offers").where("price is not null and product_name is not null and region is not null and currency rlike '^[A-Z]{3}$'")
    said = o.select("id", "region", "currency", C("price").cast("decimal(18,2)").alias("amount"), F.concat("product_name", F.lit(" is listed at "), "currency", F.lit(" "), C("price").cast("decimal(18,2)").cast("string"), F.lit(" in "), "region").alias("s"))
    back = lambda k: F.regexp_extract("s", r"is listed at ([A-Z]{3}) ([\d.]+) in (\w+)$", k)
    return said.where((back(1) == C("currency")) & (back(2).try_cast("decimal(18,2)") == C("amount")) & (back(3) == C("region"))).select("id", F.length("s").cast("long").alias("n"))


SQL["statement_roundtrip"] = """SELECT id, CAST(length(product_name || ' is listed at ' || currency || ' ' || CAST(CAST(price AS DECIMAL(18,2)) AS VARCHAR) || ' in ' || region) AS BIGINT) AS n FROM offers
WHERE price IS NOT NULL AND product_name IS NOT NULL AND region IS NOT NULL AND regexp_matches(currency, '^[A-Z]{3}$')"""


def markdown_text(spark, d):
    """Characters of captures without heading marks, bullets, links and emphasis."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace("content", r"\[([^\]]*)\]\([^)]*\)", "$1"), r"(?m)^[ \t]*(?:#{1,6}|[-*•→])[ \t]+", ""), r"[*_`]", "")
    return table(spark, d, "raw_evidence").where("content is not null").select("id", F.length(text).cast("long").alias("chars"), F.length("content").cast("long").alias("raw_chars"))


SQL["markdown_text"] = r"""SELECT id, CAST(length(regexp_replace(regexp_replace(regexp_replace(content, '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '(?m)^[ \t]*(?:#{1,6}|[-*•→])[ \t]+', '', 'g'), '[*_`]', '', 'g')) AS BIGINT) AS chars,
CAST(length(content) AS BIGINT) AS raw_chars FROM raw_evidence WHERE content IS NOT NULL"""

#: Path segments that name a page type; the longest one in a path decides.
PAGE_TYPES = {"pricing": "pricing", "product": "product", "review": "review", "guide": "docs", "compare": "comparison", "blog": "article", "news": "article", "about": "company", "privacy": "legal"}


def page_types(spark, d):
    """The page type that a path names, beside the recorded one."""
    p = table(spark, d, "research_pages").select("page_type", F.explode(F.split(F.lower(F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^?#]*)", 1)), "/")).alias("segment"), "id")
    named = F.create_map(*[F.lit(x) for pair in PAGE_TYPES.items() for x in pair])[C("segment")]
    best = p.groupBy("id", "page_type").agg(F.max_by(named, F.when(named.isNotNull(), F.struct(F.length("segment"), C("segment")))).alias("by_path"))
    return best.groupBy("page_type", F.coalesce("by_path", F.lit("other")).alias("by_path")).agg(F.count("*").alias("pages"))


SQL["page_types"] = r"""SELECT page_type, coalesce(by_path, 'other') AS by_path, count(*) AS pages FROM (SELECT id, page_type, arg_max(t, (length(segment), segment)) AS by_path FROM
(SELECT id, page_type, segment, v.t FROM (SELECT id, page_type, unnest(string_split(lower(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)), '/')) AS segment FROM research_pages) LEFT JOIN (VALUES """ + ",".join(f"('{k}','{v}')" for k, v in PAGE_TYPES.items()) + """) v(k, t) ON segment = k)
GROUP BY id, page_type) GROUP BY 1, 2"""

QUERIES = {name: globals()[name] for name in SQL}
