"""The queries ``opN_<name>`` and ``pipeline``: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversations, jaccard_join, language_id, line_dedup, matroska, merkle, packing, sharding, spotsigs, suffix_dedup, toxicity, warc
from .common import held_out, settle, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.filter(~held_out(F.col("doc_id"))))
    found = language_id.identify(docs, model, spans=False)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_spans")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.filter(~held_out(F.col("doc_id"))))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.store_text(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op6_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprint_edits(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_decode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.assign(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = settle(warc.write_arc(table(spark, sf_dir, "pages")), "zstd")
    return warc.read_warc(warc.to_warc(archives)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeats(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    return conversations.repair(conversations.damage(given), given)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return merkle.verify(table(spark, sf_dir, "documents"), hit=hit, tampered={"text": merkle.ascii_lower(F.col("text"))})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_toxicity": op2_toxicity,
    "op3_matroska": op3_matroska,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_spotsigs": op6_spotsigs,
    "op7_bpe": op7_bpe,
    "op8_packing": op8_packing,
    "op9_sharding": op9_sharding,
    "op10_warc": op10_warc,
    "op11_line_dedup": op11_line_dedup,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_merkle": op13_merkle,
    "pipeline": corpus_pipeline.run,
}

# Fixed value: the alphabet of base32.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _base32_sql(hexadecimal: str) -> str:
    """Base32 of 40 hexadecimal digits: each five of them are four letters."""
    letter = lambda i, shift: f"substr('{_BASE32}', 1 + cast((('0x' || substr({hexadecimal}, {1 + 5 * i}, 5))::bigint >> {shift}) & 31 as integer), 1)"
    return " || ".join(letter(i, shift) for i in range(8) for shift in (15, 10, 5, 0))


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text, by its table."""
    rows = range(256)
    for _ in range(8):
        rows = [x >> 1 ^ (0xEDB88320 if x & 1 else 0) for x in rows]
    table = f"{list(rows)}::bigint[]"
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {codes}), lambda a, b: xor(a >> 8, ({table})[1 + (xor(a, b) & 255)])), 4294967295)"


def _merkle_sql(levels: int = 5, upper: int = 3) -> str:
    """Trees of up to 16**levels leaves, and up to 16**upper of them."""
    field = lambda v: f"coalesce(strlen({v}) || ':' || {v}, '-')"
    low = f"translate(text, '{_LETTERS}', '{_LETTERS.lower()}')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id::varchar", "source", "lang", "n_chars::varchar", text))) + ")"
    near = "partition by tree, pos // 16 order by pos rows between"
    parts = [
        f"l as (select doc_id, coalesce('s' || source, 'n') as tree, {leaf('text')} as d, case when {_crc32_sql('doc_id::varchar')} % 5 = 0 then {leaf(low)} end as changed from documents)",
        "n0 as (select *, row_number() over (partition by tree order by doc_id nulls first, d) - 1 as pos, count(*) over (partition by tree) as n from l)",
    ]

    def grow(name: str, height: int) -> None:
        for k in range(height):
            parts.append(f"{name}s{k} as (select tree, pos, coalesce(string_agg(d, '') over ({near} unbounded preceding and 1 preceding), '') as b, coalesce(string_agg(d, '') over ({near} 1 following and unbounded following), '') as a from {name}{k} where n > 1)")
            parts.append(f"{name}{k + 1} as (select tree, pos // 16 as pos, (n + 15) // 16 as n, sha256(string_agg(d, '' order by pos)) as d from {name}{k} where n > 1 group by tree, pos // 16, n)")

    grow("n", levels)
    parts.append("roots as (" + " union all ".join(f"select tree as name, d from n{k} where n = 1" for k in range(levels + 1)) + ")")
    parts.append("t0 as (select name, 'all' as tree, d, row_number() over (order by name) - 1 as pos, count(*) over () as n from roots)")
    grow("t", upper)
    parts.append("top as (" + " union all ".join(f"select d as root from t{k} where n = 1" for k in range(upper + 1)) + ")")
    joins, steps = "", [("ns", k, "n0.tree", "n0.pos") for k in range(levels)] + [("ts", k, "'all'", "t0.pos") for k in range(upper)]
    proof, folded = "''", "coalesce(changed, n0.d)"
    columns = []
    for i, (name, k, tree, pos) in enumerate(steps):
        joins += f" left join {name}{k} as x{i} on x{i}.tree = {tree} and x{i}.pos = {pos} // {16**k}"
        proof += f" || coalesce(x{i}.b || x{i}.a, '')"
        columns.append(f"x{i}.b as b{i}, x{i}.a as a{i}")
    parts.append(f"p as (select n0.doc_id, n0.d as leaf, t0.d as subroot, sha256({proof}) as proof_sha256, {folded} as f, {', '.join(columns)} from n0 join t0 on t0.name = n0.tree{joins})")
    before = "p"
    for i in range(len(steps)):
        parts.append(f"f{i} as (select * exclude (f), case when b{i} is null then f else sha256(b{i} || f || a{i}) end as f from {before})")
        before = f"f{i}"
    return f"with {', '.join(parts)} select doc_id, leaf, subroot, root, proof_sha256, f as folded_root, f = root as verified from {before}, top"


def _repair_sql() -> str:
    """The cheapest edits as a recursion over messages: of each state the least ``cost, initials``, with the cost in six digits."""
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    add = lambda v, c, e: f"lpad((substr({v}, 1, 6)::int + {c})::varchar, 6, '0') || substr({v}, 7) || '{e}'"
    # after insertions: states 0 nothing, 1 system, 2 user, 3 assistant
    two = f"least(v2, {add('v0', 2, 'I')}, {add('v1', 2, 'I')}, {add('v3', 2, 'I')}, {add(add('v0', 2, 'I'), 4, 'II')}, {add(add('v1', 2, 'I'), 4, 'II')})"
    three = f"least(v3, {add('v2', 2, 'I')}, {add('v0', 4, 'II')}, {add('v1', 4, 'II')})"
    keep = lambda v, i: f"case when not gone and i = '{i}' then {add(v, 'cut', 'K')} end"
    role = lambda v: f"case when not gone then {add(v, '2 + cut', 'R')} end"
    new = [
        add("v0", 3, "D"),
        f"least({add('v1', 3, 'D')}, {keep('v0', 's')})",
        f"least({add('v2', 3, 'D')}, {', '.join(keep(v, 'u') + ', ' + role(v) for v in ('v0', 'v1', 'v3'))})",
        f"least({add('v3', 3, 'D')}, {keep('v2', 'a')}, {role('v2')})",
    ]
    return f"""
        with recursive d as (select conv_id, turn, {_crc32_sql("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as k, coalesce(role, ' ') as role, coalesce(text, ' ') as text from conversations),
        e as (select conv_id, turn, case when k = 4 then 'user' else role end as role, case k when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
                     unnest(case when k = 3 then [0, 1] else [0] end) as copy from d where k <> 0),
        r as (select *, row_number() over (partition by conv_id order by turn nulls first, sha256(strlen(role) || ':' || role || text)) as p,
                     rtrim(text, {space}) as s from e),
        f as (select *, case when s = '' then 'blank' when row_number() over (partition by conv_id, role, text order by p) > 1 then 'duplicate' when right(s, 1) not in ('.', '!', '?') then 'truncated' end as fault,
                     lag(role[1]) over (partition by conv_id order by p) || role[1] as pair from r),
        m as materialized (select conv_id, p, role[1] as i, coalesce(fault in ('blank', 'duplicate'), false) as gone, case when fault = 'truncated' then 1 else 0 end as cut from f),
        w as (select conv_id, 0::bigint as p, '000000' as v0, null::varchar as v1, null::varchar as v2, null::varchar as v3 from (select distinct conv_id from f)
              union all
              select conv_id, p, {', '.join(f'{x} as v{i}' for i, x in enumerate(new))}
              from (select m.conv_id, m.p, i, gone, cut, v0, v1, {two} as v2, {three} as v3 from w join m on m.conv_id is not distinct from w.conv_id and m.p = w.p + 1)),
        l as (select conv_id, max(p) as p from m group by conv_id),
        b as (select w.conv_id, least(v0, {three}) as best from w join l on l.conv_id is not distinct from w.conv_id and l.p = w.p),
        a as (select conv_id, substr(best, 1, 6)::bigint as cost, substr(best, 7) as audit from b),
        t as (select conv_id, unnest(range(1, length(audit) + 1)) as q, audit from a),
        u as (select conv_id, q, audit[q] as x, length(regexp_replace(audit[:q - 1], 'I', '', 'g')) + 1 as p from t),
        o as (select u.*, role, text, row_number() over (partition by u.conv_id order by q) + coalesce((first_value(x = 'K' and role[1] = 's') over (partition by u.conv_id order by q))::int, 0) as nth
              from u left join f on f.conv_id is not distinct from u.conv_id and f.p = u.p where x <> 'D'),
        h as (select conv_id, string_agg(case when x = 'K' then role when nth % 2 = 1 then 'user' else 'assistant' end || ':' || case when x = 'I' then '' else text end, chr(10) order by q) as body from o group by conv_id),
        c as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate,
                     count(*) filter (where fault = 'truncated') as truncated, count(*) filter (where pair not in ('su', 'ua', 'au')) as illegal from f group by conv_id)
        select x.conv_id, {', '.join(f'coalesce({k}, 0)::bigint as {k}' for k in ('gaps', 'blank', 'duplicate', 'truncated', 'illegal', 'cost'))}, coalesce(audit, '') as audit, sha256(coalesce(body, '')) as repaired_sha256
        from (select distinct conv_id from conversations) x left join c on c.conv_id is not distinct from x.conv_id left join a on a.conv_id is not distinct from x.conv_id left join h on h.conv_id is not distinct from x.conv_id"""


ORACLES: dict[str, str] = {
    "op10_warc": f"""
        with p as (select page_id, coalesce(html, '') as body from pages), h as (select *, sha1(body) as d, max(page_id) over (partition by body) as top from p)
        select page_id, cast(strlen(body) as bigint) as payload_bytes, {_base32_sql("d")} as payload_digest,
               case when page_id = top then 'response' else 'revisit' end as record_type, case when page_id <> top then top end as refers_to from h""",
    "op11_line_dedup": """
        with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
             l as (select r, doc_id, unnest(string_split(t, chr(10))) as line, unnest(range(len(string_split(t, chr(10))))) as i from d),
             k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
             lost as (select key, max(doc_id) as keeper from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
             f as (select k.*, lost.key is not null and k.doc_id is distinct from keeper as gone from k left join lost using (key))
        select any_value(doc_id) as doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
               sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256 from f group by r""",
    "op12_conversation_repair": _repair_sql(),
    "op13_merkle": _merkle_sql(),
}
