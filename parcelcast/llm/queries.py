"""Registered queries of the operators: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parcelcast.llm import chat, decontaminate, html_text, lexical, lm_score, merkle, nearest, ngram_join, order_minhash, pieces, repeats, token_file, toxicity
from parcelcast.llm.common import table, written
from parcelcast.session import scratch_path


def tokenizer_json(name: str = "word_bpe_49k.json") -> str:
    """A public tokenizer's file, read on the driver and sent to the workers (under 2 MB)."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def fold() -> Column:
    """crc32 of the document's id as text, modulo 5."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"), fold() == 1)


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-file")
    token_file.write_token_file(table(spark, sf_dir, "documents"), path, tokenizer_json(), end_id=2)
    return token_file.read_digests(spark, path)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.train(pages))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    """Learned from the labelled rows of ``docs`` outside fold 0."""
    return toxicity.train(toxicity.labelled(docs, table(spark, sf_dir, "labels"), fold() == 0))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.score(docs, toxicity_model(spark, docs, sf_dir))
    return found.select("row.doc_id", "score", "n_sentences", F.size("at_fault").alias("n_at_fault")).select(
        "doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", "n_at_fault")


def piece_vocabulary(name: str = "piece_bpe_32k.model") -> pieces.Vocabulary:
    import public_tokenizers

    return pieces.Vocabulary.load(public_tokenizers.path(name))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, as a hash, and the hash of the text that decoding them gives."""
    vocabulary = piece_vocabulary()
    found = pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), vocabulary), vocabulary)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_xxhash64"), F.length("text").cast("long").alias("n_chars"),
                        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matches of every document that has one: a row for each document and benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark"))
    return found.select("row.doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string"))
    return chat.digests(written(chat.format_trees(chat.chain(rows)), "chats"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"))


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.compare_edited(table(spark, sf_dir, "documents"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.repeats(table(spark, sf_dir, "documents"))
    n_bytes = F.coalesce(F.octet_length("row.text"), F.lit(0)).cast("long")
    return found.select("row.doc_id", n_bytes.alias("n_bytes"), (n_bytes - F.octet_length("kept")).alias("n_removed"),
                        F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof, and whether what is held (without line ends, for half of the ids) folds to the root."""
    docs = table(spark, sf_dir, "documents")
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 != 0
    held = F.when(F.coalesce(odd, F.lit(True)), F.col("text")).otherwise(F.replace("text", F.lit("\n"), F.lit("")))
    found = merkle.manifest(docs, held)
    folded = merkle.fold(F.coalesce("held_leaf", "leaf"), F.col("path"))
    return found.select("doc_id", "leaf", "subroot", "root", merkle.siblings_hash(F.col("path")).alias("proof_sha256"),
                        folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_score": op1_lm_score,
    "op2_token_file": op2_token_file,
    "op3_html_text": op3_html_text,
    "op4_toxicity": op4_toxicity,
    "op5_pieces": op5_pieces,
    "op6_decontaminate": op6_decontaminate,
    "op7_chat": op7_chat,
    "op8_ngram_join": op8_ngram_join,
    "op9_order_minhash": op9_order_minhash,
    "op10_repeats": op10_repeats,
    "op11_ranked_search": op11_ranked_search,
    "op12_merkle": op12_merkle,
    "op13_nearest": op13_nearest,
}
_ESCAPED = r"regexp_replace({0}, '(\\*)(\[/?INST\]|</?s>|<</?SYS>>|<</?ROLE>>|<<END>>)', '\1\1\\\2', 'g')"

def _terms(text: str) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"regexp_extract_all(translate({text}, '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


def _leaf(text: str) -> str:
    framed = [f"coalesce(octet_length(encode({c}::varchar)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(framed)})"


def _climb(name: str, start: str) -> str:
    """Levels of the trees of each group g: nodes (level, g, i, n, h)."""
    return f"""{name} as (
          select 0 as level, g, i, n, h from ({start})
          union all
          select level + 1, g, i // 3, (n + 2) // 3, sha256(string_agg(h, '' order by i)) from {name} where n > 1 group by level, g, i // 3, n)"""


def _siblings(rows: str, nodes: str, level: str) -> str:
    return f"""select r.rid, {level} + o.level as level, s.i < o.i as before, s.i, s.h, o.i as own
          from {rows} r join {nodes} o on o.g is not distinct from r.g and o.i = r.i // (3 ** o.level)::bigint and o.n > 1
          left join {nodes} s on s.g is not distinct from o.g and s.level = o.level and s.i // 3 = o.i // 3 and s.i <> o.i"""


_CRC = """xor(list_reduce([4294967295::bigint] || [ord(c)::bigint for c in string_split(doc_id::varchar, '')],
            lambda a, x: list_reduce([xor(a, x)] || [0::bigint for k in range(8)], lambda b, k: case when b & 1 = 1 then xor(b >> 1, 3988292384::bigint) else b >> 1 end)), 4294967295::bigint)"""

#: The other operators train, hash or search; tests/llm holds them against brute force.
ORACLE: dict[str, str] = {
    "op7_chat": f"""
        with said as (
          select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
          union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]')
        select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
          coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
          sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
          sum(length({_ESCAPED.format('text')}) + case role when 'user' then 15 when 'assistant' then 8 when 'system' then 16
            else 26 + length({_ESCAPED.format('role')}) end)::bigint as formatted_chars
        from said group by conv_id""",
    "op11_ranked_search": f"""
        with words as (
          select rid, doc_id, unnest({_terms('text')}) as term from (select row_number() over () as rid, * from documents)),
        tf as (select rid, doc_id, term, count(*) as tf from words group by all),
        lengths as (select rid, count(*) as n from words group by rid),
        totals as (select count(*) as docs, sum(n)::bigint as terms from lengths),
        asked as (select item_id, term, count(*) as q from (select item_id, unnest({_terms('text')}) as term from benchmark) group by all),
        weights as (
          select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)))::bigint as w
          from (select term, count(*) as df from tf where term in (select term from asked) group by term), totals),
        scored as (
          select item_id, rid, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms))))::bigint as score
          from asked join weights using (term) join tf using (term) join lengths using (rid), totals group by item_id, rid, doc_id)
        select item_id, cast(rank as integer) as rank, doc_id, score
        from (select *, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank from scored where score > 0) where rank <= 10""",
    "op12_merkle": f"""
        with recursive hashed as (
          select row_number() over () as rid, doc_id, source as g, {_leaf('text')} as h, {_leaf("replace(text, chr(10), '')")} as cut, {_CRC} % 2 = 0 as tampered from documents),
        leaves as (select *, row_number() over (partition by g order by doc_id nulls first, h) - 1 as i, count(*) over (partition by g) as n from hashed),
        {_climb('nodes', 'select g, i, n, h from leaves')},
        subroots as (select g as source, h, row_number() over (order by g nulls first) - 1 as i, count(*) over () as n from nodes where n = 1),
        {_climb('tops', 'select 0 as g, i, n, h from subroots')},
        upper as (select l.rid, 0 as g, s.i from leaves l join subroots s on s.source is not distinct from l.g),
        parts as ({_siblings('leaves', 'nodes', '0')} union all {_siblings('upper', 'tops', '1000')}),
        steps as (
          select rid, row_number() over (partition by rid order by level) as step,
            coalesce(string_agg(h, '' order by i) filter (before), '') as l, coalesce(string_agg(h, '' order by i) filter (not before), '') as r
          from parts group by rid, level),
        folded as (
          select rid, 0::bigint as step, case when tampered then cut else h end as h from leaves
          union all
          select f.rid, f.step + 1, sha256(s.l || f.h || s.r) from folded f join steps s on s.rid = f.rid and s.step = f.step + 1),
        proofs as (select rid, sha256(coalesce(string_agg(h, '' order by level, i), '')) as proof from parts group by rid)
        select l.doc_id, l.h as leaf, s.h as subroot, t.h as root, coalesce(p.proof, sha256('')) as proof_sha256, f.h as folded_root, f.h = t.h as verified
        from leaves l join subroots s on s.source is not distinct from l.g join (select h from tops where n = 1) t on true
        left join proofs p on p.rid = l.rid
        join (select rid, arg_max(h, step) as h from folded group by rid) f on f.rid = l.rid""",
}
