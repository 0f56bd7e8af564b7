"""The registered queries of this subpackage, each the whole of its operator over its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from airlens.llm import bitpack, bpe, dialogue, fingerprint, langid, neardup, packing, ranked, repeats, toxicity, urlfilter, warc, webp
from airlens.llm.common import table

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.learn(docs))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.predict(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORDS)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), BYTES)


def op7_packed_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitpack.read_ids(*bitpack.write_ids(table(spark, sf_dir, "documents"), BYTES))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judged(table(spark, sf_dir, "pages"))


def op10_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.digests(table(spark, sf_dir, "documents"))


def op11_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.repair(dialogue.damaged(table(spark, sf_dir, "conversations")))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_toxicity, op3_best_fit_packing, op4_fingerprints, op5_warc, op6_bpe_round_trip, op7_packed_token_ids, op8_near_duplicates, op9_url_filter, op10_webp, op11_repeated_passages, op12_conversation_repair, op13_ranked_search)}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERMS = f"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


def _edit(value: str, edit: str, cost: str, turn: str = "''") -> str:
    """A state's [cost, edits, turns] after one more edit; null stays null."""
    return f"[lpad(({value}[1]::int + {cost})::varchar, 9, '0'), {value}[2] || '{edit}', {value}[3] || {turn}]"


def _least(*values: str) -> str:
    """The cheapest of states, of equal ones the least edits."""
    return f"list_sort(list_filter([{', '.join(f'case when {guard} then {v} end' for guard, v in values)}], lambda x: x is not null))[1]"


def _repair_sql() -> str:
    """The shortest path row by row, in a recursion over the rows of a conversation."""
    crc = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(s) + 1), lambda j: ascii(s[j])::bigint)),
        lambda c, b: list_reduce(list_prepend(xor(c, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::bigint)"""
    own, user, assistant = "chr(10) || role || ':' || text", "chr(10) || 'user:' || text", "chr(10) || 'assistant:' || text"
    held = lambda v: f"{v} is not null"
    may = lambda v, more="true": f"{v} is not null and not must_go and {more}"
    stay = lambda v: (held(v), _edit(v, "D", "4"))
    to = lambda v, turn: (may(v), _edit(v, "R", "(3 + extra)", turn))
    keep = lambda v, letter: (may(v, f"first = '{letter}'"), _edit(v, "K", "extra", own))
    more = lambda v, turn: (held(v), _edit(v, "I", "3", f"chr(10) || '{turn}:'"))
    return f"""with recursive shown as (select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') s from conversations),
        hit as (select *, {crc} % 20 how from shown), convs as (select conv_id, row_number() over () k from (select distinct conv_id from conversations)),
        damaged as (select k, turn, case how when 4 then 'user' else role end role, case how when 1 then '' when 2 then translate(text, '.!?', '') else text end text, how
            from hit join convs on convs.conv_id is not distinct from hit.conv_id where how <> 0),
        twice as (select k, turn, role, text from damaged union all select k, turn, role, text from damaged where how = 3),
        placed as (select *, row_number() over (partition by k order by turn nulls first, role, text) n, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) body, substr(role, 1, 1) first from twice),
        faulty as (select *, case when body = '' then 'blank' when row_number() over (partition by k, role, text order by n) > 1 then 'duplicate' when substr(body, -1, 1) not in ('.', '!', '?') then 'truncated' else '' end fault,
            lag(first) over (partition by k order by n) || first pair from placed),
        ready as (select *, fault in ('blank', 'duplicate') must_go, case when fault = 'truncated' then 3 else 0 end extra from faulty),
        path(k, i, n0, s0, u0, a0) as (
            select k, 0::bigint, ['000000000', '', ''], null::varchar[], ['000000003', 'I', chr(10) || 'user:'], ['000000006', 'II', chr(10) || 'user:' || chr(10) || 'assistant:'] from convs
            union all
            select k, i, n1, s1, u2, {_least((held("a1"), "a1"), more("u2", "assistant"))} from (
                select *, {_least((held("u1"), "u1"), more("n1", "user"), more("s1", "user"), more("a1", "user"))} u2 from (
                    select path.k, i + 1 i, {_least(stay("n0"))} n1, {_least(stay("s0"), keep("n0", "s"))} s1,
                        {_least(stay("u0"), to("n0", user), to("s0", user), to("a0", user), keep("n0", "u"), keep("s0", "u"), keep("a0", "u"))} u1,
                        {_least(stay("a0"), to("u0", assistant), keep("u0", "a"))} a1
                    from path join ready on ready.k = path.k and ready.n = path.i + 1))),
        size as (select convs.k, conv_id, count(n) rows_left, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint gaps, count(*) filter (fault = 'blank') blank, count(*) filter (fault = 'duplicate') duplicate,
            count(*) filter (fault = 'truncated') truncated, count(*) filter (pair is not null and pair not in ('su', 'ua', 'au')) illegal from convs left join ready using (k) group by 1, 2),
        best as (select size.*, {_least((held("n0"), "n0"), (held("a0"), "a0"))} b from size join path on path.k = size.k and path.i = rows_left)
        select conv_id, gaps, blank, duplicate, truncated, illegal, b[1]::bigint as cost, b[2] audit, sha256(substr(b[3], 2)) repaired_sha256 from best"""


#: Others can't be said in SQL whole (tokenizers, float training, files); tests/llm has brute-force versions.
SQL: dict[str, str] = {
    # Every string of 200 bytes by its digest; texts in pieces, as a place in a long one is slow to reach.
    "op11_repeated_passages": """with raw as (select row_number() over () r, doc_id, hex(encode(coalesce(text, ''))) h from documents),
    parts as (select r, q, substr(h, 2 * q + 1, 4398) t from (select r, h, unnest(range(0, length(h) // 2 - 199, 2000)) q from raw where length(h) >= 400)),
    starts as (select r, q, t, unnest(range(0, length(t) // 2 - 199)) o from parts),
    keyed as (select r, q + o p, md5_number(substr(t, 2 * o + 1, 400)) as key from starts),
    again as (select r, p from keyed where key in (select key from keyed group by key having count(*) > 1)),
    placed as (select r, p, coalesce(p > lag(p) over o + 200, true) fresh, least(200, coalesce(lead(p) over o - p, 200)) own from again window o as (partition by r order by p)),
    runs as (select r, min(p) a, (sum(own) + min(p))::bigint b from (select *, sum(fresh::int) over (partition by r order by p) g from placed) group by r, g),
    holes as (select r, coalesce(lag(b) over (partition by r order by a), 0) a, a as b from runs union all select r, max(b), (1 << 30)::bigint from runs group by r),
    kept as (select r, string_agg(substr(h, 2 * a + 1, 2 * (least(b, length(h) // 2) - a)), '' order by a) k from holes join raw using (r) group by r),
    counts as (select r, sum(b - a)::bigint n_removed, count(*) n_spans from runs group by r)
    select doc_id, (length(h) // 2)::bigint n_bytes, coalesce(n_removed, 0)::bigint n_removed, coalesce(n_spans, 0)::bigint n_spans, sha256(unhex(coalesce(k, h))) kept_sha256 from raw left join counts using (r) left join kept using (r)""",
    "op12_conversation_repair": _repair_sql(),
    "op13_ranked_search": f"""
        with d as (select row_number() over () as r, doc_id, {_TERMS} as ts from documents where text is not null),
        size as (select r, doc_id, len(ts)::bigint as n from d where len(ts) > 0),
        whole as (select count(*)::bigint as big_n, sum(n)::bigint as big_l from size),
        dt as (select r, t, count(*)::bigint as tf from (select r, unnest(ts) as t from d) group by r, t),
        b as (select row_number() over () as i, item_id, {_TERMS} as ts from (select distinct item_id, text from benchmark where text is not null)),
        bt as (select i, item_id, t, count(*)::bigint as times from (select i, item_id, unnest(ts) as t from b) group by i, item_id, t),
        w as (select t, floor(1000 * ln((2 * big_n + 2)::double / (2 * df + 1)::double))::bigint as w
              from (select t, count(*)::bigint as df from dt where t in (select t from bt) group by t), whole),
        s as (select i, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))))::bigint as score
              from bt join w using (t) join dt using (t) join size using (r), whole group by i, item_id, r, doc_id),
        k as (select item_id, (row_number() over (partition by i order by score desc, doc_id))::int as rank, doc_id, score from s where score > 0)
        select item_id, rank, doc_id, score from k where rank <= 20""",
}
