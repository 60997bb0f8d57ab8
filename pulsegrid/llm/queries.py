"""Registered queries of the numbered operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import chat, decontaminate, infill, langid, licences, lines, neardup, neighbours, packing, privacy, sharding, spelling, toxicity

#: Arrow batches of texts are bounded in bytes as well as in rows.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16777216",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    for key, value in BATCHES.items():
        spark.conf.set(key, value)


def remainder(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo `modulus`; a null id reads as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`lang_pred` is the best language even where the operator rejects it (`rejected`, `lang`)."""
    bound_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = remainder(5) == 0
    model = langid.fit(docs, train=~held_out)
    found = langid.identify(docs, model, held_out)
    return found.select("doc_id", "held_out", F.col("lang_best").alias("lang_pred"), "score", "lang", "margin", "rejected")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    turns = chat.with_probe(table(spark, sf_dir, "conversations"))
    return chat.digests(chat.format_chats(turns))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def packed(docs: DataFrame) -> DataFrame:
    """The pieces of `docs` with a checksum instead of their ids."""
    pieces = packing.pack_documents(docs, tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return packed(table(spark, sf_dir, "documents"))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    return toxicity.fit(docs, labels, train=remainder(3) != 1)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    docs = table(spark, sf_dir, "documents")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    rows = docs.select(F.col("doc_id").cast("long"), (remainder(3) == 1).alias("held_out"), "text")
    predicted = (F.col("score") >= toxicity.Settings.threshold).cast("int")
    return toxicity.score(rows, model, ["doc_id", "held_out"]).withColumn("predicted", predicted)


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return licences.scan_licences(table(spark, sf_dir, "documents"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return neighbours.search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("id") % 20 == 0)


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    return privacy.sanitise(docs, ["doc_id"]).drop("masked")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    turned = infill.fill_in_middle(table(spark, sf_dir, "documents"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(infill.restored(), 256).alias("restored_sha256")]
    return turned.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    left = lines.drop_repeated_lines(docs, ["doc_id"])
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_chat_format": op2_chat_format,
    "op3_sharding": op3_sharding,
    "op4_decontamination": op4_decontamination,
    "op5_packing": op5_packing,
    "op6_toxicity": op6_toxicity,
    "op7_licence_scan": op7_licence_scan,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_personal_data": op10_personal_data,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_line_dedup": op13_line_dedup,
}


def _chat_sql() -> str:
    template = chat.Template()

    def escaped(column: str) -> str:
        out = f"replace({column}, '\\', '\\\\')"
        for s in template.strings():
            out = f"replace({out}, '{s}', '{s[0]}\\{s[1:]}')"
        return out

    marks = len(template.open) + len(template.sep) + len(template.close)
    said = "</s>[INST] ok [/INST]"
    return f"""
        with turns as (
            select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
            union all select -1, 0, 'user', '{said}'
            union all select -1, 1, 'assistant', '{said}'
        ),
        joined as (
            select conv_id,
                   count(*) as n_turns,
                   string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as whole,
                   coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '') as learned,
                   cast(sum({marks} + length({escaped('role')}) + length({escaped('text')})) as bigint) as formatted_chars
            from turns group by conv_id
        )
        select conv_id, n_turns, sha256(whole) as turns_sha256, length(learned) as loss_chars,
               sha256(learned) as loss_sha256, formatted_chars
        from joined
    """


_NEAR_DUPLICATES = """
    with recursive words as (
        select doc_id, list_filter(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\x09-\\x0D]+'), lambda x: x <> '') as w
        from documents
    ),
    shingles as (
        select distinct doc_id, unnest(case
            when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
            when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s
        from words
    ),
    sizes as (select doc_id, count(*) as n from shingles group by doc_id),
    shared as (
        select a.doc_id as a, b.doc_id as b, count(*) as n_both
        from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by all
    ),
    links as (
        select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b
        where 100 * n_both >= 75 * (x.n + y.n - n_both)
    ),
    reach(doc_id, other) as (
        select doc_id, doc_id from documents
        union select reach.doc_id, links.b from reach join links on reach.other = links.a
    )
    select d.doc_id, coalesce(any_value(n), 0) as n_shingles, min(other) as component_id, d.doc_id = min(other) as kept
    from documents d join reach using (doc_id) left join sizes using (doc_id) group by d.doc_id
"""


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_SPELLING_VARIANTS = f"""
    with recursive crc(i, c, k) as (
        select cast(i as ubigint), cast(i as ubigint), 0 from range(256) t(i)
        union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from crc where k < 8
    ),
    crc_table as (select list(c order by i) as t from crc where k = 8),
    runs as (
        select coalesce(cast(doc_id as varchar), '') as id, unnest(regexp_extract_all({_LOWERED}, '[A-Za-z\u00C0-\u00FF]+')) as run from documents
    ),
    counted as (select id, run, count(*) as n from runs where length(run) >= 5 group by all),
    coded as (select run, n, hex(encode(id || ':' || run)) as x, t from counted, crc_table),
    hashed as (
        select run, n, xor(4294967295, list_reduce(
            list_prepend(cast(4294967295 as ubigint), list_transform(range(1, length(x), 2), lambda i: cast('0x' || substr(x, i, 2) as ubigint))),
            lambda c, b: xor(c >> 8, t[cast((xor(c, b) & 255) + 1 as bigint)]))) as h
        from coded
    ),
    said as (
        select n, case when h % 97 = 0 then substr(run, 1, cast(h % length(run) as int)) || substr(run, cast(h % length(run) as int) + 2) else run end as word
        from hashed
    ),
    words as (select word, cast(sum(n) as bigint) as n from said where length(word) >= 5 group by word having sum(n) >= 3),
    shortened as (
        select distinct word, n, i, substr(word, 1, i) || substr(word, i + 2) as short
        from (select word, n, unnest(range(length(word))) as i from words)
    ),
    pairs as (
        select a.word, b.word as other, b.n as n_other from shortened a join shortened b on a.short = b.short and a.i = b.i and a.word <> b.word
        union select s.word, w.word, w.n from shortened s join words w on w.word = s.short
        union select w.word, s.word, s.n from shortened s join words w on w.word = s.short
    ),
    near as (select word, count(*) as n_near, max(n_other) as best_n from pairs group by word),
    best as (select p.word, min(p.other) as other from pairs p join near on near.word = p.word and near.best_n = p.n_other group by p.word),
    forms as (
        select w.word, w.n, coalesce(n_near, 0) as n_near, case when best_n >= 2 * w.n then other end as form, case when best_n >= 2 * w.n then best_n end as form_n
        from words w left join near on near.word = w.word left join best on best.word = w.word
    ),
    steps(word, root) as (select word, word from forms union select s.word, f.form from steps s join forms f on f.word = s.root where f.form is not null)
    select f.word, f.form, s.root, f.n, f.n_near, f.form_n
    from forms f join steps s on s.word = f.word join forms last on last.word = s.root and last.form is null
"""

_FILL_IN_MIDDLE = """
    with drawn as (
        select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h,
               regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as units
        from documents
    ),
    numbered as (
        select doc_id, text, units, len(units) as n, cast('0x' || substr(h, 1, 8) as bigint) % (len(units) + 1) as c1,
               cast('0x' || substr(h, 9, 8) as bigint) % (len(units) + 1) as c2,
               cast('0x' || substr(h, 17, 8) as bigint) % 100 as d3, cast('0x' || substr(h, 25, 8) as bigint) % 100 as d4
        from drawn
    ),
    formed as (
        select *, case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or d3 >= 90 then 'plain'
                       when d4 < 20 then 'spm' else 'psm' end as form,
               array_to_string(units[1:least(c1, c2)], '') as prefix,
               array_to_string(units[least(c1, c2) + 1:greatest(c1, c2)], '') as middle,
               array_to_string(units[greatest(c1, c2) + 1:n], '') as suffix
        from numbered
    )
    select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then length(prefix) end as prefix_chars,
           case when form <> 'plain' then length(middle) end as middle_chars,
           sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                            else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
           sha256(text) as restored_sha256
    from formed
"""

_LINE_DEDUP = f"""
    with docs as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as ls, string_split({_LOWERED}, chr(10)) as low from documents),
    lined as (select r, doc_id, unnest(range(1, len(ls) + 1)) as i, unnest(ls) as line, trim(unnest(low), ' ' || chr(9) || chr(11) || chr(12) || chr(13)) as key from docs),
    frequent as (select key from lined where key <> '' group by key having count(distinct r) >= 10)
    select any_value(doc_id) as doc_id, count(*) as n_lines, count(frequent.key) as n_dropped,
           sha256(coalesce(string_agg(line, chr(10) order by i) filter (frequent.key is null), '')) as kept_sha256
    from lined left join frequent on frequent.key = lined.key group by r
"""


ORACLE: dict[str, str] = {
    "op2_chat_format": _chat_sql(),
    "op8_minhash_near_dedup": _NEAR_DUPLICATES,
    "op11_spelling_variants": _SPELLING_VARIANTS,
    "op12_fill_in_middle": _FILL_IN_MIDDLE,
    "op13_line_dedup": _LINE_DEDUP,
}
