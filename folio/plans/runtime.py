"""Queries over the job runtime, the cache, solving and files."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import runtime as R
from ..operators import structure as P
from ..session import scratch
from ..sources import files as S
from ..streaming import jobs as J
from .registry import FILE, Derived, Inline, file_of, query, table

EVENTS = "SELECT CAST(user_id AS VARCHAR) AS job, CAST(event_id % 5 AS INTEGER) AS file, event_type AS status, event_id AS seq, ts FROM events"


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as job events: a user is a job with five files."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("job"), (F.col("event_id") % 5).cast("int").alias("file"), F.col("event_type").alias("status"), F.lit("").alias("message"), F.col("event_id").alias("seq"), "ts")


@query(f"WITH e AS ({EVENTS}) SELECT job, file, arg_max(status, seq) AS status FROM e GROUP BY 1, 2")
def job_status_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latest_status(job_events(spark, sf_dir)).select("job", "file", "status")


@query(f"WITH e AS ({EVENTS}), s AS (SELECT job, file, arg_max(status, seq) IN ('purchase', 'signup') AS final FROM e GROUP BY 1, 2) SELECT job, count(*) AS n_files, count(*) FILTER (final) AS n_done, bool_and(final) AS all_done FROM s GROUP BY 1")
def all_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = job_events(spark, sf_dir).withColumn("status", F.when(F.col("status").isin("purchase", "signup"), "done").otherwise("processing"))
    return R.finished_jobs(R.latest_status(named))


@query(f"WITH e AS ({EVENTS}) SELECT job, file, arg_max(status, seq) AS status FROM e GROUP BY 1, 2")
def job_status_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream: events as a file source, folded batch by batch."""
    source = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/events.parquet*")
    rows = stream.select(F.col("user_id").cast("string").alias("job"), (F.col("event_id") % 5).cast("int").alias("file"), F.col("event_type").alias("status"), F.lit("").alias("message"), F.col("event_id").alias("seq"), "ts")
    path = scratch(spark, "job-status")
    J.write_status(rows, path, scratch(spark, "job-status-log"), once=True).awaitTermination()
    return J.current(spark, path).select("job", "file", "status")


CACHE = "SELECT substr(sha1(coalesce(text, '') || 'model' || 'v1'), 1, 20) AS key, doc_id AS page FROM documents"


@query(f"WITH p AS ({CACHE}), c AS (SELECT DISTINCT key, page FROM p WHERE page % 3 = 0) SELECT key, page FROM p WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.key = p.key AND c.page = p.page)")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    pages = d.select(R.cache_key(F.coalesce("text", F.lit("")), F.lit("model"), F.lit("v1")).alias("key"), F.col("doc_id").alias("page"))
    return pages.join(pages.filter("page % 3 = 0"), ["key", "page"], "left_anti")


@query(f"WITH p AS ({CACHE}) SELECT count(*) AS n, count(*) FILTER (page % 3 = 0 OR page % 2 = 0) AS good, count(*) FILTER (page % 3 = 0 OR page % 2 = 0) AS kept FROM p")
def cache_grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    pages = d.select(R.cache_key(F.coalesce("text", F.lit("")), F.lit("model"), F.lit("v1")).alias("key"), F.col("doc_id").alias("page"))
    read = lambda p: p.select("key", "page", F.lit("t").alias("text"), (F.col("page") % 2 == 0).alias("ok"))
    all_pages, cache = R.with_cache(pages, pages.filter("page % 3 = 0").withColumn("text", F.lit("c")), read)
    return all_pages.agg(F.count("*").alias("n"), F.count_if("ok").alias("good")).crossJoin(cache.agg(F.count("*").alias("kept")))


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def cache_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts")).first()[0]
    return R.evict(e.select("event_id", F.col("ts").alias("used_at")), F.lit(now)).select("event_id")


@query("SELECT event_id FROM events WHERE ts < (SELECT max(ts) FROM events) - CASE WHEN event_type = 'click' THEN INTERVAL 2 DAY ELSE INTERVAL 7 DAY END")
def expired_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts")).first()[0]
    days = F.when(F.col("event_type") == "click", 2).otherwise(7)
    return R.expired(e.withColumn("modified", F.col("ts")), F.lit(now), days).select("event_id")


@query("WITH t AS (SELECT " + FILE + " AS doc, row_number() OVER (PARTITION BY " + FILE + """ ORDER BY doc_id) - 1 AS page, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN '  ' ELSE 'm' || doc_id END AS a, CASE WHEN doc_id % 8 = 0 THEN NULL ELSE 'o' || doc_id END AS b FROM documents),
    c AS (SELECT doc, page, coalesce(nullif(trim(coalesce(a, '')), ''), nullif(trim(coalesce(b, '')), '')) AS x FROM t)
    SELECT doc, md5(string_agg('<!-- p2w:page=' || (page + 1) || ' -->' || chr(10) || coalesce(x, '> ⚠️ **[Trang ' || (page + 1) || ']**'), chr(10) || chr(10) ORDER BY page)) AS h, coalesce(string_agg(CASE WHEN x IS NULL THEN CAST(page + 1 AS VARCHAR) END, ',' ORDER BY page), '') AS failed FROM c GROUP BY 1""")
def pages_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    i = F.col("doc_id")
    p = table(spark, sf_dir, "documents").select(file_of().alias("doc"), (F.row_number().over(Window.partitionBy(file_of()).orderBy("doc_id")) - 1).alias("page"), F.when(i % 4 == 0, None).when(i % 4 == 1, "  ").otherwise(F.concat(F.lit("m"), i.cast("string"))).alias("a"), F.when(i % 8 == 0, None).otherwise(F.concat(F.lit("o"), i.cast("string"))).alias("b"))
    return R.converted(p, ["a", "b"]).select("doc", F.md5("markdown").alias("h"), F.array_join("failed", ",").alias("failed"))


SOLVE = Derived("asked", "documents", "doc string, question_id string, t string, v string", ["concat('d', doc_id % 9)", "concat('q', doc_id)", "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE concat('text ', lang) END", "CASE WHEN doc_id % 4 = 0 THEN concat('vision ', n_chars) ELSE NULL END"])


@query(f"WITH {SOLVE.cte} SELECT doc, question_id, coalesce(v, t, '(chưa có lời giải)') AS solution FROM asked")
def solutions_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = SOLVE.df(spark, sf_dir)
    pick = lambda c: a.filter(F.col(c).isNotNull()).select("doc", "question_id", F.col(c).alias("solution"))
    return R.solved(a.select("doc", "question_id"), pick("t"), pick("v"))


ASKED = Inline("asked", "doc string, gnum int, label string, text string, options array<string>, sub_items array<string>", [
    ("d", 1, "PHẦN I", "q1", ["A. x", "B. y"], []), ("d", 2, "PHẦN I", "q2", [], ["a. m"]), ("d", 3, "PHẦN II", None, [], []), ("e", 1, None, "alone", [], []), ("e", 2, "", "none", [], [])])


@query(f"""WITH {ASKED.cte}, p AS (SELECT *, 'all' AS part FROM asked UNION ALL SELECT *, 'some' FROM asked WHERE doc = 'd' AND gnum = 3),
    n AS (SELECT *, lag(label) OVER w AS was, row_number() OVER w AS place FROM p WINDOW w AS (PARTITION BY part, doc ORDER BY gnum)),
    b AS (SELECT doc, part, gnum, CASE WHEN coalesce(label, '') <> '' AND (place = 1 OR label IS DISTINCT FROM was) THEN chr(10) || '== ' || label || ' ==' || chr(10) ELSE '' END
        || chr(10) || '[CÂU ' || gnum || ']' || chr(10) || coalesce(text, '') || CASE WHEN len(options) > 0 THEN chr(10) || '  ' || array_to_string(options, '  ') ELSE '' END
        || CASE WHEN len(sub_items) > 0 THEN chr(10) || '  ' || array_to_string(sub_items, chr(10) || '  ') ELSE '' END AS block FROM n)
    SELECT doc, part, string_agg(block, chr(10) ORDER BY gnum) AS prompt FROM b GROUP BY 1, 2""")
def solver_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = ASKED.df(spark)
    return R.prompts(q).withColumn("part", F.lit("all")).unionByName(R.prompts(q, spark.createDataFrame([("d", 3)], "doc string, gnum int")).withColumn("part", F.lit("some")))


@query("SELECT CAST(conv_id AS VARCHAR) AS request, md5(string_agg(text, '' ORDER BY turn)) AS h, count(*) AS n FROM conversations GROUP BY 1")
def chunks_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    chunks = c.select(F.col("conv_id").cast("string").alias("request"), F.col("turn").alias("seq"), F.lit("chunk").alias("type"), "text")
    return J.answers(chunks).join(chunks.groupBy("request").agg(F.count("*").alias("n")), "request").select("request", F.md5("text").alias("h"), "n")


RANGES = Inline("ranges", "i int, r string, n int", [(1, "1-3,5", 10), (2, "2, 2, x,9-12", 10), (3, "", 5), (4, None, 5), (5, "7-5,0,4", 6), (6, "3-", 4)])


@query(f"WITH {RANGES.cte}, p AS (SELECT i, n, unnest(string_split(replace(coalesce(r, ''), ' ', ''), ',')) AS x FROM ranges), q AS (SELECT i, n, CAST(string_split(x, '-')[1] AS INTEGER) AS lo, CAST(coalesce(string_split(x, '-')[2], string_split(x, '-')[1]) AS INTEGER) AS hi FROM p WHERE regexp_matches(x, '^[0-9]+(-[0-9]+)?$')), e AS (SELECT DISTINCT i, k - 1 AS k FROM q, range(1, 20) g(k) WHERE k BETWEEN lo AND hi AND k <= n) SELECT r.i, coalesce((SELECT string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) FROM e WHERE e.i = r.i), '') AS pages FROM ranges r")
def page_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RANGES.df(spark).select("i", F.array_join(F.transform(S.page_numbers(F.col("r"), F.col("n")), lambda x: x.cast("string")), ",").alias("pages"))


@query(f"WITH p AS (SELECT {FILE} AS doc, row_number() OVER (PARTITION BY {FILE} ORDER BY doc_id) - 1 AS page FROM documents) SELECT doc, page FROM p WHERE doc NOT IN ('src1/0', 'src2/0') OR (doc = 'src1/0' AND page IN (0, 1, 2, 5)) OR (doc = 'src2/0' AND page >= 3)")
def selected_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    p = table(spark, sf_dir, "documents").select(file_of().alias("doc"), (F.row_number().over(Window.partitionBy(file_of()).orderBy("doc_id")) - 1).cast("long").alias("page"))
    return S.select_pages(p, spark.createDataFrame([("src1/0", "1-3, 6"), ("src2/0", "4-9999")], "doc string, pages string"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'docx' WHEN 1 THEN CASE WHEN doc_id % 3 = 0 THEN 'text' WHEN doc_id % 2 = 0 THEN 'model' ELSE 'text' END WHEN 2 THEN CASE WHEN doc_id % 2 = 0 THEN 'model' ELSE 'placeholder' END ELSE 'error' END AS route FROM documents")
def file_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    name = F.when(i % 5 == 0, "a.docx").when(i % 5 == 1, "b.PDF").when(i % 5 == 2, "c.png").otherwise("d.xyz")
    return table(spark, sf_dir, "documents").select("doc_id", S.route(name, i % 2 == 0, i % 3 == 0).alias("route"))


def sample_docx() -> bytes:
    """A small DOCX file: numbered paragraphs, an option table and a picture."""
    w, a, r = (f'xmlns:{k}="{v[1:-1]}"' for k, v in (("w", S.WORD), ("a", S.DRAWING), ("r", S.RELATION)))
    p = lambda t, n="": f"<w:p>{n}<w:r><w:t>{t}</w:t></w:r></w:p>"
    num = '<w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr></w:pPr>'
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    table_xml = f"<w:tbl><w:tr>{cell('A. 1')}{cell('B. 2')}</w:tr><w:tr>{cell('C. 3')}{cell('D. 4')}</w:tr></w:tbl>"
    body = p("PHẦN I. TRẮC NGHIỆM") + p("Tính vận tốc của vật rơi", num) + '<w:p><w:r><a:blip r:embed="rId1"/></w:r></w:p>' + table_xml + "<w:sdt><w:sdtContent>" + p("Tính gia tốc của vật này", num) + "</w:sdtContent></w:sdt>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w} {a} {r}><w:body>{body}</w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Id="rId1" Target="media/image1.png"/></Relationships>')
    return out.getvalue()


@query()
def docx_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.createDataFrame([("a.docx", bytearray(sample_docx())), ("b.docx", bytearray(b"no"))], "path string, content binary")
    return P.parse(S.docx_items(S.read_docx(files)))


@query("SELECT doc_id, 'x' || doc_id AS title, 'khac' AS doc_type FROM documents")
def image_placeholders_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("up/x"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path"))
    return S.placeholder(d).join(d, "path").select("doc_id", "title", "doc_type")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0 WHEN doc_id % 2 = 0 THEN 1 ELSE -1 END AS step FROM documents")
def model_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    readers = [lambda f: f["doc_id"].map(lambda i: "whole" if i % 3 == 0 else None), lambda f: f["doc_id"].map(lambda i: "strip" if i % 2 == 0 else None)]
    return S.read_with_model(table(spark, sf_dir, "documents").select("doc_id"), readers).select("doc_id", "step")


@query("SELECT " + FILE + " AS doc, md5('<html><body>' || string_agg('<p><b>Câu ' || doc_id || '.</b> ' || replace(replace(replace(replace(regexp_replace(text, '[$\\n]', ' ', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') || '</p>', chr(10) ORDER BY doc_id) || '</body></html>') AS h FROM documents GROUP BY 1")
def print_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "documents").select(file_of().alias("doc"), F.col("doc_id").alias("gnum"), F.regexp_replace("text", "[$\n]", " ").alias("text"), F.lit(None).cast("array<string>").alias("options"), F.lit(None).cast("string").alias("solution"))
    return S.print_html(q).select("doc", F.md5("html").alias("h"))



@query("""WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS request, conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq, text, TIMESTAMP '2026-01-01' + INTERVAL 1 HOUR * conv_id + INTERVAL 1 SECOND * turn AS ts FROM conversations),
    c AS (SELECT request, conv_id % 7 AS kind, count(*) AS n, string_agg(text, '' ORDER BY seq) AS said, max(ts) AS last FROM t GROUP BY 1, 2),
    w AS (SELECT max(last) - INTERVAL 1 MINUTE AS mark FROM c)
    SELECT request, 'chunk' AS event, seq, md5(text) AS h FROM t
    UNION ALL SELECT request, CASE kind WHEN 3 THEN 'failed' WHEN 5 THEN 'stale' ELSE 'finished' END, n, md5(CASE kind WHEN 3 THEN 'no' ELSE said END) FROM c, w WHERE kind <> 5 OR last + INTERVAL 10 MINUTE <= mark""")
def solver_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as requests, an hour apart: turns are chunks, read in reverse; some end with an error and some never."""
    from ..streaming import solver

    schema = table(spark, sf_dir, "conversations").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/conversations.parquet*")
    # A turn's number is the chunk's; the first turn tells how many there are, by a table that is small as a column of numbers.
    sizes = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    named = rows.join(sizes, "conv_id")
    ts = F.timestamp_seconds(F.lit(1767225600) + F.col("conv_id") * 3600 + F.col("turn"))
    end = F.struct((F.col("turn") + 1).alias("seq"), F.when(F.col("conv_id") % 7 == 3, "error").otherwise("done").alias("type"), F.when(F.col("conv_id") % 7 == 3, "no").alias("text"))
    chunk = F.struct(F.col("turn").alias("seq"), F.lit("chunk").alias("type"), "text")
    last = (F.col("turn") == F.col("n") - 1) & (F.col("conv_id") % 7 != 5)
    events = named.select(F.col("conv_id").cast("string").alias("request"), ts.alias("ts"), F.explode(F.when(last, F.array(end, chunk)).otherwise(F.array(chunk))).alias("e"))
    path = scratch(spark, "solver")
    solver.write_events(solver.solver_events(events.select("request", "e.*", "ts")), path, scratch(spark, "solver-log"), once=True).awaitTermination()
    return spark.read.schema(solver.EVENTS).parquet(path).select("request", "event", "seq", F.md5("text").alias("h"))
