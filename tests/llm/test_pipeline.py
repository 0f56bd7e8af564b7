"""The pipeline's stages on odd rows, on empty tables, and against brute force on the smallest table."""

import numpy as np
import pyarrow.parquet as pq

from pyspark.sql import functions as F

import corpus_pipeline
from airlens.llm import bitpack, bpe, fingerprint, langid, neardup, packing, toxicity, urlfilter, warc, webp
from airlens.llm.queries import BYTES, WORDS
from tests.llm.cases import SCHEMA, documents, empty
from tests.llm.test_documents import brute_components, check_packing


def test_stages_bear_odd_rows_and_empty_tables(spark):
    sf = "/root/testdata/sf0.01"
    for make in (documents, empty):
        docs = make(spark)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before = docs
            docs = spark.createDataFrame(stage(spark, docs, sf).collect(), before.schema)
            assert docs.columns == before.columns, name
        got = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
        assert len({r["doc_id"] for r in got}) == docs.count()


def test_rows_without_an_id(spark):
    """No operator fails on them; all give them a row."""
    docs = spark.createDataFrame([(None, "one two three four five six", "en", "s", 1, "x", "y", 1), (None, None, None, None, None, None, None, None), (5, "one two three four five six", "en", "s", 1, "x", "y", 1)], SCHEMA)
    assert langid.predict(docs, {"en": [101]}).count() == 3
    assert toxicity.predict(docs, toxicity.Model(np.zeros(0, np.int32), np.zeros(0), -1.0)).count() == 3
    assert packing.pack(docs, WORDS).count() == 3 and fingerprint.fingerprints(docs).count() == 3 and bpe.round_trip(docs, BYTES).count() == 3 and webp.digests(docs).count() == 3
    assert bitpack.read_ids(*bitpack.write_ids(docs, BYTES)).count() == 3
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in neardup.near_duplicates(docs).collect())
    assert got == [(0, 0, True), (0, 5, False), (5, 5, True)]
    pages = spark.createDataFrame([(None, "http://a.com/en/", "x"), (1, "http://a.com/en/", "x")], "page_id long, url string, html string")
    assert warc.archived(pages).count() == 2 and urlfilter.judged(pages).count() == 2


def test_pipeline_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    got = corpus_pipeline.run(spark, sf).collect()
    docs = {d["doc_id"]: d["text"] for d in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    table = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.learn(table, spark.read.parquet(f"{sf}/labels.parquet"))
    toxic = {r["doc_id"] for r in toxicity.predict(table, model).where("predicted = 1").collect()}
    left = {i: t for i, t in docs.items() if i not in toxic}
    left = {i: t for i, t in left.items() if any(c.isalpha() for c in t)}
    assert len(toxic) < 0.2 * len(docs) and len(left) > 0.8 * len(docs)
    kept = sorted(i for i, (_, least) in brute_components(left.items()).items() if i == least)
    assert sorted({r["doc_id"] for r in got}) == kept
    check_packing([r.asDict() for r in got], [(i, docs[i]) for i in kept])


OTHERS = {
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
    "hu": "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek.",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
    "ja": "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。",
}


def test_language_stage_drops_other_languages(spark):
    """Planted documents in languages that nobody labelled go; the table's own with letters stay, one in a thousand aside."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    planted = spark.createDataFrame([(10**9 + k, t, None, "src", len(t)) for k, t in enumerate(OTHERS.values())], docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.keep_known_languages(spark, docs.union(planted), sf).collect()}
    own = {r["doc_id"] for r in docs.collect() if r["text"] and any(c.isalpha() for c in r["text"])}
    assert not {i for i in kept if i >= 10**9} and len(own - kept) <= len(own) / 1000 and kept <= own


def test_stages_bear_columns_of_their_own_names(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(300)
    names = ("toxicity", "lang_pred", "lang_score", "score", "node", "kept", "component_id", "_rank0", "unit", "n_shingles")
    docs = docs.select("*", *(F.lit("mine").alias(c) for c in names)).cache()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.where(" or ".join(f"{c} <> 'mine'" for c in names)).count() == 0, name
        assert 0 < out.count() <= docs.count()


def test_no_text_of_an_id_is_lost(spark):
    """Rows of one id with different texts are one document; only copies and repeated rows go."""
    a, b, c = ("alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight", "uno dos tres cuatro cinco seis siete ocho")
    rows = [(1, a), (1, b), (2, b), (3, c), (3, c), (5, c), (4, None), (4, None), (None, a), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"] or 0, r["text"] or "") for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()))
    assert got == sorted([(1, a), (1, b), (3, c), (4, ""), (0, a), (0, a)])
    groups = {(r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(docs).collect()}
    assert groups == {(1, 1), (2, 1), (3, 3), (5, 3), (4, 4), (None, 1)}
