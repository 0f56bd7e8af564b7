"""The model's frames made from the supplied tables, as DataFrames and as the same DuckDB SQL.

    recordings  documents: an hour of station `source`, within the 30 days from 2024-01-01
    words       its text's words, 0.3 s apart
    segments    its lines of five words or more
    blocks      fixed lengths for three models, types and confidences by arithmetic
    verdicts    labels on the blocks of model A, with second opinions on every fourth
    items       embeddings, 20 minutes apart
    articles    pages
    versions    conversations: a conversation is a news item, a turn a version
    log         events: commands, messages and polls by user
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airlens.functions.text import tokens

#: Block types; the five of JUNK are no news.
TYPES = ("noticia", "publicidad", "religioso", "promo", "musica", "relleno", "desconocido")
JUNK = ("publicidad", "religioso", "promo", "musica", "relleno")
MODELS = (("A", 40, 0), ("B", 55, 1), ("C", 70, 2))

_T0 = "timestamp_ntz'2024-01-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    start = F.expr(f"{_T0} + make_dt_interval(0, cast(doc_id % 720 as int))")
    state = F.expr("case doc_id % 4 when 0 then 'pendiente' when 1 then 'procesando' else 'procesada' end")
    return docs.select(F.col("doc_id").alias("rec_id"), F.col("source").alias("medio"), start.alias("fecha_inicio"), state.alias("estado"), "lang", "n_chars")


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rec_id"), F.col("source").alias("medio"), tokens(F.col("text")).alias("words"), "text")


def start_at(index: Column) -> Column:
    return index * 3 / F.lit(10.0)


def end_at(index: Column) -> Column:
    return (index * 30 + 28) / F.lit(100.0)


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts with the times of their words as arrays."""
    start, end = F.transform("words", lambda w, i: start_at(i)), F.transform("words", lambda w, i: end_at(i))
    return transcripts(spark, sf_dir).withColumns({"starts": start, "ends": end})


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transcripts(spark, sf_dir).select("rec_id", "medio", F.posexplode("words").alias("index", "word"))
    return out.select("rec_id", "medio", "index", "word", (F.col("index") * 3 / F.lit(10.0)).alias("start"), ((F.col("index") * 30 + 28) / F.lit(100.0)).alias("end"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rec_id"), F.col("source").alias("medio"), F.transform(F.split("text", "\n"), tokens).alias("lines"))
    # Words before each line, summed up inside the row: no shuffle of all lines.
    starts = F.aggregate("lines", F.array(F.lit(0).cast("long")), lambda s, x: F.array_append(s, F.element_at(s, -1) + F.size(x)))
    lines = docs.select("rec_id", "medio", F.posexplode(F.arrays_zip("lines", starts.alias("starts"))).alias("seg", "l"))
    lines = lines.select("rec_id", "medio", "seg", F.col("l.lines").alias("w"), F.col("l.starts").alias("start_word"))
    kept = lines.where(F.size("w") >= 5)
    return kept.select(
        "rec_id", "medio", "seg", "start_word", (F.col("start_word") + F.size("w") - 1).alias("end_word"),
        F.array_join(F.slice("w", 1, 8), " ").alias("title"), F.array_join("w", " ").alias("summary"),
        F.filter("w", lambda x: x.rlike("^[A-Z]")).alias("people"), F.slice("w", 2, 3).alias("keywords"), F.size("w").alias("n_words"),
        F.expr("case (rec_id + seg) % 3 when 0 then 'positivo' when 1 then 'negativo' else 'neutro' end").alias("sentiment"),
        F.expr(f"{_T0} + make_dt_interval(0, cast(rec_id % 720 as int), 0, cast(start_word as decimal(18,6)))").alias("momento"),
    )


def segment_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, seg, title, people of segments(), for callers that ask for no places or times."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rec_id"), F.posexplode(F.split("text", "\n")).alias("seg", "line"))
    kept = lines.select("rec_id", "seg", tokens(F.col("line")).alias("w")).where(F.size("w") >= 5)
    return kept.select("rec_id", "seg", F.array_join(F.slice("w", 1, 8), " ").alias("title"), F.filter("w", lambda x: (x >= "A") & (x < "[")).alias("people"))


def blocks(spark: SparkSession, sf_dir: str, *more: str, models: tuple[str, ...] = ("A", "B", "C")) -> DataFrame:
    """more: further columns of the transcripts that the blocks carry along."""
    recs = transcripts(spark, sf_dir).select("rec_id", "medio", F.size("words").alias("n"), *more).where("n > 0")
    model = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.lit(size).alias("size"), F.lit(k).alias("k")) for m, size, k in MODELS if m in models)))
    out = recs.select("*", model.alias("m")).select("rec_id", "medio", "n", *more, "m.*")
    out = out.select("*", F.explode(F.expr("sequence(0, cast((n - 1) div size as int))")).alias("idx"))
    out = out.withColumn("start_word", F.col("idx") * F.col("size")).withColumn("end_word", F.least(F.col("n") - 1, (F.col("idx") + 1) * F.col("size") - 1))
    kind = F.expr("(rec_id * 31 + (start_word div 120) * 7 + case when (rec_id + idx + k) % 5 = 0 then k + 1 else 0 end) % 7").cast("int")
    return out.select(
        "model", "rec_id", "medio", F.expr("cast(pmod(rec_id - 6, 24) as int)").alias("hora_local"), F.col("n").alias("n_words"), "idx", "start_word", "end_word",
        F.element_at(F.array(*map(F.lit, TYPES)), kind + 1).alias("tipo"), ((50 + F.expr("(rec_id * 7 + idx * 13 + k) % 50")) / F.lit(100.0)).alias("confidence"), *more,
    )


def block_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, medio, hora_local, blocks (of all models, as structs): the rows of blocks(), a recording's in one row without a shuffle."""
    recs = transcripts(spark, sf_dir).select("rec_id", "medio", F.size("words").alias("n")).where("n > 0")

    def of_model(model: str, size: int, k: int) -> Column:
        def block(idx: Column) -> Column:
            start, rec, n = idx * size, F.col("rec_id"), F.col("n")
            odd = F.when((rec + idx + k) % 5 == 0, k + 1).otherwise(0)
            kind = ((rec * 31 + F.floor(start / 120) * 7 + odd) % 7).cast("int")
            said = (50 + (rec * 7 + idx * 13 + k) % 50) / F.lit(100.0)
            return F.struct(F.lit(model).alias("model"), idx.alias("idx"), start.alias("start_word"), F.least(n - 1, start + size - 1).alias("end_word"), F.element_at(F.array(*map(F.lit, TYPES)), kind + 1).alias("tipo"), said.alias("confidence"))

        return F.transform(F.sequence(F.lit(0), F.expr(f"cast((n - 1) div {size} as int)")), block)

    return recs.select("rec_id", "medio", F.expr("cast(pmod(rec_id - 6, 24) as int)").alias("hora_local"), F.concat(*(of_model(*m) for m in MODELS)).alias("blocks"))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = blocks(spark, sf_dir).where("model = 'A'").join(table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "rec_id"), "rec_id")
    real = F.when(F.col("toxic") == 0, "noticia").otherwise("publicidad")
    first = own.select("rec_id", "idx", "model", F.concat(F.lit("u"), F.col("rec_id") % 3).alias("validador"), (F.col("quality") == 1).alias("ok"), real.alias("tipo_real"), F.col("idx").cast("long").alias("ts"))
    second = own.where("idx % 4 = 0").select("rec_id", "idx", "model", F.lit("v").alias("validador"), (F.col("toxic") == 0).alias("ok"), F.lit("musica").alias("tipo_real"), (F.col("idx") + 1).cast("long").alias("ts"))
    return first.union(second)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding", "label", (F.col("vec_id") * 20).alias("minute"), (F.col("vec_id") % 15).alias("medio"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return pages.select("page_id", host.alias("host"), F.col("url").alias("guid"), title.alias("title"), (F.col("page_id") % 500).alias("day"), (F.length("html") > 2000).alias("has_body"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("turn") % 3 != 2, F.col("text"))
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("news_id"), (F.col("turn") + 1).cast("int").alias("numero"), "role", text.alias("titulo"), F.length("text").alias("n_chars"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("string").alias("at"), F.floor(F.col("event_id") * 4).cast("long").alias("minute"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


_SQL = {
    "recordings": """select doc_id rec_id, source medio, timestamp '2024-01-01' + to_hours(doc_id % 720) fecha_inicio,
        case doc_id % 4 when 0 then 'pendiente' when 1 then 'procesando' else 'procesada' end estado, lang, n_chars from documents""",
    "transcripts": "select doc_id rec_id, source medio, list_filter(string_split_regex(text, '[ \\t\\n\\r]+'), lambda x: x <> '') words, text from documents",
    "words": """select rec_id, medio, (i - 1)::int as index, words[i] word, (i - 1) * 3 / 10.0 as start, ((i - 1) * 30 + 28) / 100.0 as "end"
        from (select rec_id, medio, words, unnest(range(1, len(words) + 1)) i from transcripts)""",
    "segments": """select rec_id, medio, seg, start_word, start_word + len(w) - 1 end_word, array_to_string(w[1:8], ' ') title, array_to_string(w, ' ') summary,
        list_filter(w, lambda x: regexp_matches(x, '^[A-Z]')) people, w[2:4] keywords, len(w) n_words,
        case (rec_id + seg) % 3 when 0 then 'positivo' when 1 then 'negativo' else 'neutro' end sentiment,
        timestamp '2024-01-01' + to_hours(rec_id % 720) + to_seconds(start_word) momento
        from (select *, coalesce(sum(len(w)) over (partition by rec_id order by seg rows between unbounded preceding and 1 preceding), 0)::bigint start_word
            from (select rec_id, medio, (seg - 1)::int seg, list_filter(string_split_regex(lines[seg], '[ \\t\\n\\r]+'), lambda x: x <> '') w
                from (select doc_id rec_id, source medio, string_split(text, chr(10)) lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) seg from documents)))
        where len(w) >= 5""",
    "blocks": """select model, rec_id, medio, ((rec_id - 6) % 24 + 24) % 24 hora_local, n n_words, idx, start_word, end_word,
        (['noticia','publicidad','religioso','promo','musica','relleno','desconocido'])[(rec_id * 31 + (start_word // 120) * 7 + case when (rec_id + idx + k) % 5 = 0 then k + 1 else 0 end) % 7 + 1] tipo,
        (50 + (rec_id * 7 + idx * 13 + k) % 50) / 100.0::double confidence
        from (select *, (idx * size)::int start_word, least(n - 1, (idx + 1) * size - 1)::int end_word
            from (select *, unnest(range(0, (n - 1) // size + 1))::int idx
                from (select rec_id, medio, len(words) n from transcripts where len(words) > 0), (values ('A', 40, 0), ('B', 55, 1), ('C', 70, 2)) m(model, size, k)))""",
    "verdicts": """select rec_id, idx, model, 'u' || (rec_id % 3) validador, quality = 1 ok, case when toxic = 0 then 'noticia' else 'publicidad' end tipo_real, idx ts
            from blocks join labels on doc_id = rec_id where model = 'A'
        union all select rec_id, idx, model, 'v', toxic = 0, 'musica', idx + 1 from blocks join labels on doc_id = rec_id where model = 'A' and idx % 4 = 0""",
    "items": "select vec_id item_id, embedding, label, vec_id * 20 as minute, vec_id % 15 medio from embeddings",
    "articles": """select page_id, regexp_extract(url, '://([^/?#]*)', 1) host, url guid, regexp_extract(html, '<title>([^<]*)</title>', 1) title,
        page_id % 500 as day, length(html) > 2000 has_body from pages""",
    "versions": "select conv_id news_id, turn + 1 numero, role, case when turn % 3 <> 2 then text end titulo, length(text) n_chars from conversations",
    "log": "select event_id, event_id * 4 as minute, user_id, event_type, value, json_extract_string(props, '$.k')::int k from events",
}
_NEEDS = {"words": ["transcripts"], "blocks": ["transcripts"], "verdicts": ["blocks"]}


def sql(frames: str, body: str) -> str:
    """The body with the named frames before it; a body that begins with `, name as (...)` adds its own."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in _NEEDS.get(name, []):
            need(other)
        if name not in order:
            order.append(name)

    for name in frames.split():
        need(name)
    body = body.strip()
    return "with " + ", ".join(f"{n} as ({_SQL[n]})" for n in order) + ("" if body.startswith(",") else " ") + body
