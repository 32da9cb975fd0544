"""Queries on sources, pieces, pair encoding and corpus preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import bpe
from millrace.functions.pieces import piece_counts, pieces, prune_rare
from millrace.operators import corpus, windows
from millrace.operators.order import positioned
from millrace.plans.registry import query
from millrace.runtime import cut, new_path, small, spread, table
from millrace.sources import shards, text

WS = r"\t\n\x0B\f\r \x{85}\p{Z}"
#: The pieces of column `text` of table `src` in DuckDB, whose patterns know neither possessive quantifiers nor look-ahead.
_MARKED = rf"regexp_replace(text, '([{WS}])([\t\x0B\f \x{{85}}\p{{Z}}][^{WS}])', '\1' || chr(57344) || '\2', 'g')"
_RE = rf"''(?i:[sdmt\x{{17F}}]|ll|ve|re)|[^\r\n\p{{L}}\p{{N}}\x{{E000}}]?\p{{L}}+|\p{{N}}{{1,3}}| ?[^{WS}\p{{L}}\p{{N}}\x{{E000}}]+[\r\n]*|[{WS}]*[\r\n]|[{WS}]+|\x{{E000}}"
PIECES = f"list_filter(regexp_extract_all({_MARKED}, '{_RE}'), lambda x: x <> chr(57344))"
DOCS = "docs AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND text <> '')"
ORD = f"{DOCS}, o AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) AS ord, length(text) AS len, strlen(text) AS n_bytes FROM docs)"
COUNTS = f"{DOCS}, p AS (SELECT unnest({PIECES}) AS piece FROM docs), counts AS (SELECT piece, count(*) AS freq FROM p GROUP BY piece)"
#: Ten merges used where learning them isn't the point: e r, i n, a t, o n, e n, t h, r e, o r, s t, er+space-less d.
MERGES = [(101, 114, 256), (105, 110, 257), (97, 116, 258), (111, 110, 259), (101, 110, 260), (116, 104, 261), (114, 101, 262), (111, 114, 263), (115, 116, 264), (261, 101, 265)]
VAL, SHARD = 0.07, 40_000


def docs(spark, d):
    return spread(corpus.usable(table(spark, d, "documents").select("doc_id", "text")))


@query("src_1", f"WITH {DOCS} SELECT doc_id, length(text)::INT AS n_chars, md5(text) AS digest FROM docs")
def src_1(spark, d):
    return docs(spark, d).select("doc_id", F.char_length("text").alias("n_chars"), F.md5("text").alias("digest"))


@query("src_2", "SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS text FROM events WHERE props IS NOT NULL AND CAST(json_extract(props, '$.k') AS VARCHAR) NOT IN ('0', '', 'null')")
def src_2(spark, d):
    rows = table(spark, d, "events").select("event_id", text._value_text(F.col("props"), "k").alias("text"))
    return rows.where("text is not null and text <> ''")


@query("src_4", f"""WITH {DOCS}, s AS (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS a FROM docs),
u AS (SELECT doc_id, unnest(range(len(a))) AS part, unnest(a) AS t FROM s)
SELECT doc_id, part::INT AS part, (length(t) + 2)::INT AS n_chars FROM u WHERE regexp_matches(t, '[^\\t\\n\\x0B\\f\\r \\x{{85}}\\p{{Z}}\\x1C-\\x1F]')""")
def src_4(spark, d):
    parts = text.blank_line_parts(docs(spark, d), ["doc_id"])
    return parts.select("doc_id", "part", F.char_length("text").alias("n_chars"))


def ordered(spark, d):
    return positioned(docs(spark, d).select("doc_id", F.char_length("text").alias("len")), ["doc_id"], ["len"])


@query("src_10", f"WITH {ORD} SELECT doc_id FROM o ORDER BY doc_id LIMIT 100")
def src_10(spark, d):
    return docs(spark, d).select("doc_id").orderBy("doc_id").limit(100)


@query("src_11", f"WITH {ORD} SELECT doc_id, ord FROM o WHERE ord > 20 AND ord <= 120")
def src_11(spark, d):
    return text.skip_and_take(ordered(spark, d), 20, 100).select("doc_id", F.col("ord").cast("bigint").alias("ord"))


@query("src_12", f"WITH {ORD}, c AS (SELECT doc_id, sum(len) OVER (ORDER BY ord) AS upto FROM o) SELECT doc_id, upto::BIGINT AS upto FROM c WHERE upto <= 500000")
def src_12(spark, d):
    rows = text.character_budget(ordered(spark, d), 500_000)
    return rows.select("doc_id", (F.col("before_len") + F.col("len")).cast("bigint").alias("upto"))


@query("tok_1", f"WITH {DOCS}, p AS (SELECT doc_id, {PIECES} AS p FROM docs) SELECT doc_id, len(p)::INT AS n_pieces, md5(array_to_string(p, chr(1))) AS digest FROM p")
def tok_1(spark, d):
    rows = docs(spark, d).select("doc_id", pieces(F.col("text")).alias("p"))
    return rows.select("doc_id", F.size("p").alias("n_pieces"), F.md5(F.array_join("p", "\x01")).alias("digest"))


@query("tok_2", f"WITH {COUNTS} SELECT piece, freq FROM counts")
def tok_2(spark, d):
    return piece_counts(docs(spark, d))


@query("tok_2_top", f"WITH {COUNTS} SELECT piece, freq FROM counts ORDER BY freq DESC, piece LIMIT 100")
def tok_2_top(spark, d):
    return piece_counts(docs(spark, d)).orderBy(F.desc("freq"), "piece").limit(100)


@query("tok_3", f"WITH {COUNTS} SELECT piece, freq FROM counts WHERE freq >= 3 OR (SELECT count(*) FROM counts) <= 5000")
def tok_3(spark, d):
    return prune_rare(piece_counts(docs(spark, d)), 3, above=5000)


_BYTES = "regexp_extract_all(hex(encode(piece)), '..')"
_SYMS = f"syms AS (SELECT array_to_string(list_transform({_BYTES}, lambda h: chr(13312 + ('0x' || h)::INT)), '') AS w, freq FROM counts)"
_PAIRS = "SELECT substr(w, i::BIGINT, 2) AS pair, freq FROM {w}, unnest(range(1, length(w))) AS r(i)"


@query("tok_4", f"WITH {COUNTS}, {_SYMS}, pr AS ({_PAIRS.format(w='syms')}) SELECT (ord(pair) - 13312)::INT AS a, (ord(substr(pair, 2, 1)) - 13312)::INT AS b, sum(freq)::BIGINT AS cnt FROM pr GROUP BY pair")
def tok_4(spark, d):
    words = piece_counts(docs(spark, d)).select(bpe.symbols(F.col("piece")).alias("symbols"), "freq")
    c = bpe.pair_counts(words)
    code = lambda x: F.conv(F.hex(F.encode(x, "UTF-16BE")), 16, 10).cast("int") - bpe.BASE
    return c.select(code(F.substring("pair", 1, 1)).alias("a"), code(F.substring("pair", 2, 1)).alias("b"), "cnt")


@query("tok_5", f"WITH {COUNTS}, {_SYMS}, pr AS ({_PAIRS.format(w='syms')}) SELECT pair, sum(freq)::BIGINT AS cnt FROM pr GROUP BY pair ORDER BY cnt DESC, pair LIMIT 1")
def tok_5(spark, d):
    words = piece_counts(docs(spark, d)).select(bpe.symbols(F.col("piece")).alias("symbols"), "freq")
    return bpe.best_pair(bpe.pair_counts(words))


def _training_sql(k: int) -> str:
    ctes = [COUNTS, _SYMS.replace("syms AS (", "w0 AS MATERIALIZED (")]
    for i in range(k):
        ctes.append(f"b{i} AS MATERIALIZED (SELECT pair, sum(freq) AS cnt FROM ({_PAIRS.format(w=f'w{i}')}) GROUP BY pair ORDER BY cnt DESC, pair LIMIT 1)")
        ctes.append(f"w{i + 1} AS MATERIALIZED (SELECT replace(w, pair, chr({13312 + 256 + i})) AS w, freq FROM w{i}, b{i})")
    rows = " UNION ALL ".join(f"SELECT {i} AS rank, (ord(pair) - 13312)::INT AS a, (ord(substr(pair, 2, 1)) - 13312)::INT AS b, {256 + i} AS new_id FROM b{i}" for i in range(k))
    return f"WITH {', '.join(ctes)} {rows}"


@query("tok_7", _training_sql(8))
def tok_7(spark, d):
    merges = bpe.train(piece_counts(docs(spark, d)), 8)
    return bpe.merges_table(spark, bpe.Vocabulary(merges))


def _encoded_sql(out: str) -> str:
    w = "w"
    for a, b, new in MERGES:
        w = f"replace({w}, chr({13312 + a}) || chr({13312 + b}), chr({13312 + new}))"
    syms = _SYMS.replace("syms AS (SELECT", "s0 AS (SELECT piece,")
    return (
        f"WITH {COUNTS}, {syms}, enc AS MATERIALIZED (SELECT piece, {w} AS e FROM s0), "
        f"dp AS (SELECT doc_id, unnest({PIECES}) AS piece FROM docs), "
        f"t AS (SELECT doc_id, sum(length(e))::BIGINT AS n, sum(list_sum(list_transform(range(1, length(e) + 1), lambda i: ord(substr(e, i, 1)) - 13312)))::BIGINT AS id_sum FROM dp JOIN enc USING (piece) GROUP BY doc_id) "
        + out
    )


def encoded(spark, d):
    return bpe.encode(docs(spark, d), bpe.Vocabulary(MERGES))


def _sum():
    return F.expr("aggregate(ids, 0L, (x, y) -> x + y)")


@query("tok_11", f"WITH {COUNTS}, {_SYMS.replace('syms AS (SELECT', 's0 AS (SELECT piece,')}, " + "enc AS (SELECT piece, {} AS e FROM s0) SELECT piece, length(e)::INT AS n FROM enc".format(
    __import__("functools").reduce(lambda w, m: f"replace({w}, chr({13312 + m[0]}) || chr({13312 + m[1]}), chr({13312 + m[2]}))", MERGES, "w")))
def tok_11(spark, d):
    distinct = piece_counts(docs(spark, d)).select("piece")
    return bpe.encode_pieces(distinct, bpe.Vocabulary(MERGES)).select("piece", F.size("ids").alias("n"))


@query("tok_12", _encoded_sql("SELECT doc_id, n AS n_tokens, id_sum FROM t"))
def tok_12(spark, d):
    return encoded(spark, d).select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), _sum().alias("id_sum"))


_SPECIAL = ["<|endoftext|>", "<|pad|>", "<|user|>"]


@query("tok_13", "WITH t AS (SELECT item_id, choice_index, run, '<|user|>' || run || '<|pad|><|endoftext|>' || coalesce(CAST(n_tokens AS VARCHAR), '') AS s FROM (SELECT DISTINCT item_id, choice_index, run, n_tokens FROM eval_scores)) SELECT item_id, choice_index, run, len(list_filter(string_split(replace(replace(replace(s, '<|user|>', '#<|user|>#'), '<|pad|>', '#<|pad|>#'), '<|endoftext|>', '#<|endoftext|>#'), '#'), lambda x: x <> ''))::INT AS n_parts FROM t")
def tok_13(spark, d):
    rows = table(spark, d, "eval_scores").select("item_id", "choice_index", "run", "n_tokens").distinct()
    s = F.concat(F.lit("<|user|>"), "run", F.lit("<|pad|><|endoftext|>"), F.coalesce(F.col("n_tokens").cast("string"), F.lit("")))
    return rows.select("item_id", "choice_index", "run", F.size(bpe.split_specials(s, _SPECIAL)).alias("n_parts"))


_LETTERS_SUM = "coalesce(list_sum(list_transform(regexp_extract_all(hex(encode({})), '..'), lambda h: ('0x' || h)::INT)), 0)"


@query("tok_13_ids", f"""WITH t AS (SELECT item_id, choice_index, run, '<|user|>' AS u, run || '<|pad|>' AS mid, coalesce(CAST(n_tokens AS VARCHAR), '') AS tail FROM (SELECT DISTINCT item_id, choice_index, run, n_tokens FROM eval_scores WHERE run IS NOT NULL))
SELECT item_id, choice_index, run, (2 + strlen(mid) + strlen(tail))::INT AS n_ids, (258 + 256 + {_LETTERS_SUM.format('mid')} + {_LETTERS_SUM.format('tail')})::BIGINT AS id_sum FROM t""")
def tok_13_ids(spark, d):
    """Texts with specials encoded; two are allowed, the third is text."""
    rows = table(spark, d, "eval_scores").where("run is not null").select("item_id", "choice_index", "run", "n_tokens").distinct()
    s = F.concat(F.lit("<|user|>"), "run", F.lit("<|pad|><|endoftext|>"), F.coalesce(F.col("n_tokens").cast("string"), F.lit("")))
    got = bpe.encode(rows.select(F.struct("item_id", "choice_index", "run", "n_tokens").alias("at"), s.alias("text")), bpe.Vocabulary([], _SPECIAL), "at", allowed={"<|user|>", "<|endoftext|>"})
    return got.select("at.item_id", "at.choice_index", "at.run", F.size("ids").alias("n_ids"), _sum().alias("id_sum"))


@query("tok_15", """WITH e AS (SELECT DISTINCT example_id, ids FROM examples WHERE len(ids) > 0), u AS (SELECT example_id, unnest(ids) AS id, unnest(range(len(ids))) AS pos FROM e)
SELECT example_id, md5(string_agg(hex(token_bytes), '' ORDER BY pos)) AS digest FROM u JOIN vocab ON token_id = id GROUP BY example_id""")
def tok_15(spark, d):
    rows = table(spark, d, "examples").where("size(ids) > 0").select("example_id", "ids").distinct()
    long = rows.select("example_id", F.posexplode("ids").alias("pos", "token_id"))
    vocab = small(table(spark, d, "vocab").select("token_id", F.hex("token_bytes").alias("h")))
    got = long.join(vocab, "token_id", "left").withColumn("h", F.when(F.col("h").isNull(), F.raise_error(F.lit("unknown token id"))).otherwise(F.col("h")))
    parts = got.groupBy("example_id").agg(F.array_sort(F.collect_list(F.struct("pos", "h"))).alias("s"))
    return parts.select("example_id", F.md5(F.array_join(F.col("s.h"), "")).alias("digest"))


@query("tok_17", _encoded_sql("SELECT t.doc_id, strlen(text) / greatest(n, 1) AS ratio FROM t JOIN docs ON t.doc_id = docs.doc_id"))
def tok_17(spark, d):
    return lengths(spark, d, bpe.Vocabulary(MERGES)).select("doc_id", (F.col("n_bytes") / F.greatest("n", F.lit(1))).alias("ratio"))


@query("prep_1", _encoded_sql("SELECT t.doc_id, n + 1 AS n_tokens, strlen(text)::BIGINT AS n_bytes FROM t JOIN docs ON t.doc_id = docs.doc_id"))
def prep_1(spark, d):
    return lengths(spark, d, bpe.Vocabulary(MERGES)).select("doc_id", (F.col("n") + 1).alias("n_tokens"), "n_bytes")


def measured(spark, d):
    return corpus.measured(table(spark, d, "documents"), "doc_id", "text")


@query("prep_4", f"WITH {ORD} SELECT doc_id, CASE WHEN ord % 14 = 0 THEN 'val' ELSE 'train' END AS split FROM o")
def prep_4(spark, d):
    return measured(spark, d).select("doc_id", corpus.split_name(F.col("ord"), VAL).alias("split"))


@query("prep_5", f"WITH {ORD} SELECT count(*) AS n_docs, sum(n_bytes + 1)::BIGINT AS n_tokens, sum(n_bytes)::BIGINT AS n_bytes, round(sum(n_bytes) / greatest(sum(n_bytes + 1), 1), 6) AS bytes_per_token FROM o")
def prep_5(spark, d):
    return corpus.corpus_totals(measured(spark, d))


@query("prep_6", f"WITH {ORD} SELECT CASE WHEN ord % 14 = 0 THEN 'val' ELSE 'train' END AS split, count(*) AS n_docs, sum(n_bytes + 1)::BIGINT AS n_tokens, sum(n_bytes)::BIGINT AS n_bytes FROM o GROUP BY 1")
def prep_6(spark, d):
    return corpus.split_totals(measured(spark, d), VAL)


_ROLL = f"""WITH RECURSIVE {ORD}, s AS MATERIALIZED (SELECT CASE WHEN ord % 14 = 0 THEN 'val' ELSE 'train' END AS split, row_number() OVER (PARTITION BY ord % 14 = 0 ORDER BY ord) AS k, (n_bytes + 1)::BIGINT AS len FROM o),
r AS (SELECT split, k, len, 0::BIGINT AS shard, len AS run FROM s WHERE k = 1
UNION ALL SELECT s.split, s.k, s.len, r.shard + (r.run >= {SHARD})::BIGINT, CASE WHEN r.run >= {SHARD} THEN s.len ELSE r.run + s.len END FROM r JOIN s ON s.split = r.split AND s.k = r.k + 1)"""


@query("snk_5", _ROLL + " SELECT split, shard, count(*) AS n_docs, sum(len)::BIGINT AS n_tokens FROM r GROUP BY split, shard")
def snk_5(spark, d):
    return corpus.rolled(measured(spark, d), SHARD, VAL)


@query("snk_3", "SELECT item_id, CASE WHEN item_id * 8 <= 65536 THEN 'uint16' ELSE 'uint32' END AS dtype FROM eval_items")
def snk_3(spark, d):
    return table(spark, d, "eval_items").select("item_id", shards.dtype_column(F.col("item_id") * 8).alias("dtype"))


@query("snk_4", _ROLL + ", g AS (SELECT split, shard, count(*) AS d, sum(len) AS t FROM r GROUP BY split, shard) SELECT split, count(*) AS n_shards, sum(t)::BIGINT AS n_tokens, string_agg(printf('shard_%05d.bin:%d', shard, t::BIGINT), ',' ORDER BY shard) AS shards FROM g GROUP BY split")
def snk_4(spark, d):
    rows = corpus.rolled(measured(spark, d), SHARD, VAL)
    named = F.struct("shard", F.format_string("shard_%05d.bin:%d", "shard", "n_tokens").alias("s"))
    by = rows.groupBy("split").agg(F.count("*").alias("n_shards"), F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(named)).alias("l"))
    return by.select("split", "n_shards", "n_tokens", F.array_join(F.col("l.s"), ",").alias("shards"))


@query("src_16", f"""WITH RECURSIVE {ORD}, s AS MATERIALIZED (SELECT ord AS k, (n_bytes + 1)::BIGINT AS len, 256 + list_sum(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::INT)) AS x FROM o),
r AS (SELECT k, len, x, 0::BIGINT AS shard, len AS run FROM s WHERE k = 1
UNION ALL SELECT s.k, s.len, s.x, r.shard + (r.run >= {SHARD * 4})::BIGINT, CASE WHEN r.run >= {SHARD * 4} THEN s.len ELSE r.run + s.len END FROM r JOIN s ON s.k = r.k + 1)
SELECT printf('shard_%05d.bin', shard) AS shard, sum(len)::INT AS n_tokens, count(*)::INT AS n_docs, sum(x)::BIGINT AS id_sum FROM r GROUP BY shard""")
def src_16(spark, d):
    """Documents as byte tokens, written as binary shards and read back: (shard, n_tokens, n_docs, id_sum)."""
    from millrace.operators.order import restarting_groups

    rows = positioned(docs(spark, d).select("doc_id", (F.octet_length("text") + 1).cast("bigint").alias("len")), ["doc_id"], ["len"])
    grp = rows.select("doc_id", "ord").join(restarting_groups(rows, SHARD * 4, "roll"), "ord")
    ids = byte_ids(docs(spark, d)).join(grp, "doc_id").select("grp", "ord", "ids")
    path = new_path(spark, "shards")
    shards.write_shards(ids, path, 257)
    return shard_sums(shards.read_blocks(spark, path), "shard")


def shard_sums(blocks, *keys):
    """(*keys, n_tokens, n_docs, id_sum) of the blocks of shards."""
    by = blocks.select(*keys, F.size("ids").alias("n"), F.size("doc_starts").alias("d"), _sum().alias("s")).groupBy(*keys)
    return by.agg(F.sum("n").cast("int").alias("n_tokens"), F.sum("d").cast("int").alias("n_docs"), F.sum("s").alias("id_sum"))


def byte_stream(spark, d):
    """(ids, before_len) of all documents as byte tokens laid end to end; texts meet their places before they become four bytes a token."""
    placed = docs(spark, d).join(measured(spark, d).select("doc_id", "before_len"), "doc_id")
    return byte_ids(placed.select(F.struct("doc_id", "before_len").alias("at"), "text"), "at").select("ids", "at.before_len")


def byte_ids(rows, id_col: str = "doc_id", text_col: str = "text"):
    """(<id>, ids): the UTF-8 bytes of each text and an end token 256."""
    return bpe.encode(rows, bpe.Vocabulary([]), id_col, text_col).withColumn("ids", F.concat("ids", F.array(F.lit(256))))


_STREAM = f"""{ORD}, t AS (SELECT ord, n_bytes, hex(encode(text)) AS h, (sum(n_bytes + 1) OVER (ORDER BY ord) - n_bytes - 1)::BIGINT AS off FROM o),
toks AS MATERIALIZED (SELECT off + i AS pos, CASE WHEN i < n_bytes THEN ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::INT ELSE 256 END AS tok FROM t, unnest(range(n_bytes + 1)) AS r(i))"""
L = 512


@query("win_1", _ROLL + ", g AS (SELECT shard, sum(len)::BIGINT AS n FROM r WHERE split = 'train' GROUP BY shard) SELECT shard, n, (sum(n) OVER (ORDER BY shard) - n)::BIGINT AS start FROM g")
def win_1(spark, d):
    rows = corpus.rolled(measured(spark, d), SHARD, VAL).where("split = 'train'").select("shard", F.col("n_tokens").alias("n"))
    return positioned(rows, ["shard"], ["n"]).select("shard", "n", F.col("before_n").alias("start"))


@query("win_2", f"WITH {ORD} SELECT ((sum(n_bytes + 1) - 1) // {L})::BIGINT AS n_sequences FROM o")
def win_2(spark, d):
    total = F.sum(F.octet_length("text").cast("bigint") + 1)
    n = docs(spark, d).agg(F.floor((total - 1) / L).cast("bigint").alias("n_sequences"))
    return n.select(F.when(F.col("n_sequences") < 1, F.raise_error(F.lit("too few tokens")).cast("bigint")).otherwise(F.col("n_sequences")).alias("n_sequences"))


@query("win_3", f"""WITH {_STREAM}, w AS (SELECT pos // {L} AS seq_idx, pos, tok FROM toks UNION ALL SELECT pos // {L} - 1, pos, tok FROM toks WHERE pos % {L} = 0 AND pos > 0)
SELECT seq_idx::BIGINT AS seq_idx, arg_min(tok, pos) AS first, arg_max(tok, pos) AS last, sum(tok * (pos - seq_idx * {L} + 1))::BIGINT AS checksum FROM w GROUP BY seq_idx HAVING count(*) = {L + 1}""")
def win_3(spark, d):
    w = windows.windows(byte_stream(spark, d), L, 257)
    check = F.expr("aggregate(zip_with(tokens, sequence(1, size(tokens)), (t, i) -> bigint(t) * i), 0L, (x, y) -> x + y)")
    return w.select("seq_idx", F.element_at("tokens", 1).alias("first"), F.element_at("tokens", -1).alias("last"), check.alias("checksum"))


@query("win_6", f"""WITH {_STREAM}, n AS (SELECT (count(*) - 1) // {L} AS n FROM toks), w AS (SELECT pos // {L} AS seq_idx, tok, lead(tok) OVER (ORDER BY pos) AS nxt FROM toks)
SELECT seq_idx::BIGINT AS seq_idx, sum(tok)::BIGINT AS x_sum, sum(nxt)::BIGINT AS y_sum FROM w, n WHERE seq_idx < n GROUP BY seq_idx""")
def win_6(spark, d):
    x, y = windows.inputs_and_targets(F.col("tokens"), L)
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, t: a + t)
    return windows.windows(byte_stream(spark, d), L, 257).select("seq_idx", total(x).alias("x_sum"), total(y).alias("y_sum"))


@query("win_4", _ROLL + f""", g AS (SELECT shard, sum(len)::BIGINT AS n FROM r WHERE split = 'train' GROUP BY shard), f AS (SELECT shard, n, sum(n) OVER (ORDER BY shard) - n AS off FROM g)
SELECT (i * 5000)::BIGINT AS pos, shard, (i * 5000 - off)::BIGINT AS inside FROM unnest(range((SELECT sum(n) FROM g)::BIGINT // 5000)) AS t(i) JOIN f ON i * 5000 >= off AND i * 5000 < off + n""")
def win_4(spark, d):
    rows = corpus.rolled(measured(spark, d), SHARD, VAL).where("split = 'train'").select("shard", F.col("n_tokens").alias("n"))
    # Offsets are a row per shard; positions meet them by the block of 5,000 they lie in, not by comparing all with all.
    f = cut(positioned(rows, ["shard"], ["n"]).select("shard", "n", F.col("before_n").alias("off")))
    blocks = f.select("*", F.explode(F.expr("sequence(cast(ceil(off / 5000) as bigint), (off + n - 1) div 5000)")).alias("i"))
    blocks = blocks.where("i * 5000 >= off and i * 5000 < off + n")
    most = f.agg(F.expr("sum(n) div 5000")).scalar()
    return blocks.where(F.col("i") < most).select((F.col("i") * 5000).alias("pos"), "shard", (F.col("i") * 5000 - F.col("off")).alias("inside"))


@query("src_19", f"WITH {_STREAM} SELECT (pos // 10000)::BIGINT AS chunk, count(*)::INT AS n, sum(tok)::BIGINT AS id_sum FROM toks GROUP BY 1")
def src_19(spark, d):
    return windows.chunks(byte_stream(spark, d), 10_000).select("chunk", F.size("tokens").alias("n"), F.aggregate("tokens", F.lit(0).cast("bigint"), lambda a, t: a + t).alias("id_sum"))


@query("src_9", f"WITH {DOCS} SELECT md5(text) AS digest, count(*) AS n FROM docs GROUP BY 1")
def src_9(spark, d):
    """Documents written as compressed JSON lines, and read back as a corpus."""
    path = new_path(spark, "corpus", ".jsonl")
    lines = docs(spark, d).select(F.to_json(F.struct("doc_id", "text")).alias("value"))
    lines.write.option("compression", "gzip").text(path)
    return text.read_corpus(spark, path).groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"))


@query("src_3", "SELECT item_id, md5(replace(context, chr(13), chr(10)) || chr(10)) AS digest FROM (SELECT DISTINCT item_id, context FROM eval_items WHERE context IS NOT NULL)")
def src_3(spark, d):
    """Items' contexts written as a file each, and read back whole."""
    path = new_path(spark, "texts")
    rows = table(spark, d, "eval_items").where("context is not null").select("item_id", "context").distinct()
    rows.repartition(4).write.partitionBy("item_id").text(path)
    got = text.whole_texts(spark, f"{path}/*/*.txt")
    return got.select(F.regexp_extract("path", "item_id=([0-9]+)", 1).cast("bigint").alias("item_id"), F.md5("text").alias("digest"))


@query("src_22", "SELECT event_id, json_valid(CASE WHEN event_id % 3 = 0 THEN substr(props, 2) ELSE props END) AS readable FROM events")
def src_22(spark, d):
    raw = F.when(F.col("event_id") % 3 == 0, F.expr("substr(props, 2)")).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", text.manifest(raw).isNotNull().alias("readable"))


@query("snk_7", "SELECT event_type AS run, count(*) AS n, max(value) AS largest FROM events GROUP BY event_type")
def snk_7(spark, d):
    """A metric log appended to in two writes, and read back."""
    from millrace.operators import telemetry

    path = new_path(spark, "log")
    e = table(spark, d, "events")
    line = F.to_json(F.struct(F.col("event_type").alias("run"), F.col("event_id").alias("step"), telemetry.number(F.col("value").cast("string")).alias("train/loss")))
    for part in (0, 1):
        e.where(F.col("event_id") % 2 == part).select(line.alias("value")).write.mode("append").text(path)
    return text.metric_log(spark, path).groupBy("run").agg(F.count("*").alias("n"), F.max("`train/loss`").alias("largest"))


@query("snk_9", f"WITH {DOCS} SELECT doc_id, sha256(text) AS digest FROM docs")
def snk_9(spark, d):
    return docs(spark, d).select("doc_id", F.sha2("text", 256).alias("digest"))


@query("tok_18", "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{k:02X}', false)" for k in range(256)) + ", (256, '6572', false), (257, '696E', false), (258, '6174', false), (259, '6F6E', false), (260, '656E', false), (261, '7468', false), (262, '7265', false), (263, '6F72', false), (264, '7374', false), (265, '746865', false), (299, '3C7C70616E7C3E', true)) AS v(id, bytes, is_special)".replace("70616E", "706164"))
def tok_18(spark, d):
    v = bpe.Vocabulary(MERGES, ["<|pad|>"], 300)
    return bpe.vocabulary_table(spark, v).select("id", F.hex("bytes").alias("bytes"), "is_special")


# Training and encoding with a vocabulary of production size. A merge is a query of its own in SQL, so these have none; tests hold them against loops.
VOCAB_SIZE = 32_768


def learned(spark, d):
    """The vocabulary learned from all documents, the reference's default size and special."""
    counts = prune_rare(cut(piece_counts(docs(spark, d))))
    return bpe.Vocabulary(bpe.train(counts, VOCAB_SIZE - bpe.BYTES - 1), ["<|endoftext|>"], VOCAB_SIZE)


@query("tok_7_full")
def tok_7_full(spark, d):
    return bpe.merges_table(spark, learned(spark, d))


@query("tok_11_full")
def tok_11_full(spark, d):
    distinct = piece_counts(docs(spark, d)).select("piece")
    return bpe.encode_pieces(distinct, learned(spark, d)).select("piece", F.size("ids").alias("n"))


def lengths(spark, d, v):
    """(doc_id, n_bytes, n, id_sum) of all documents, encoded; a document's bytes travel with its id."""
    at = F.struct("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes")).alias("at")
    return bpe.encode(docs(spark, d).select(at, "text"), v, "at").select("at.*", F.size("ids").cast("bigint").alias("n"), _sum().alias("id_sum"))


@query("tok_12_full")
def tok_12_full(spark, d):
    return lengths(spark, d, learned(spark, d)).select("doc_id", F.col("n").alias("n_tokens"), "id_sum")


@query("tok_17_full")
def tok_17_full(spark, d):
    return lengths(spark, d, learned(spark, d)).select("doc_id", (F.col("n_bytes") / F.greatest("n", F.lit(1))).alias("ratio"))


@query("prep_1_full")
def prep_1_full(spark, d):
    return lengths(spark, d, learned(spark, d)).select("doc_id", (F.col("n") + 1).alias("n_tokens"), "n_bytes")


def encoded_lengths(spark, d):
    """measured() rows with the lengths that the learned vocabulary gives."""
    rows = lengths(spark, d, learned(spark, d)).select("doc_id", "n_bytes", (F.col("n") + 1).alias("len"))
    return positioned(rows, ["doc_id"], ["len"])


def encoded_stream(spark, d):
    """(doc_id, ids, ord, before_len, part, len): all documents, encoded with the learned vocabulary and ended, laid end to end."""
    v = learned(spark, d)
    enc = cut(bpe.encode(docs(spark, d), v).withColumn("ids", F.concat("ids", F.array(F.lit(v.end_id())))))
    return enc.join(positioned(enc.select("doc_id", F.size("ids").cast("bigint").alias("len")), ["doc_id"], ["len"]), "doc_id")


@query("prep_4_full")
def prep_4_full(spark, d):
    return encoded_lengths(spark, d).select("doc_id", "len", corpus.split_name(F.col("ord"), VAL).alias("split"))


@query("prep_5_full")
def prep_5_full(spark, d):
    return corpus.corpus_totals(encoded_lengths(spark, d))


@query("prep_6_full")
def prep_6_full(spark, d):
    return corpus.split_totals(encoded_lengths(spark, d), VAL)


@query("prep_7_full")
def prep_7_full(spark, d):
    """The whole preparation, with its shards read back: (split, shard, n_tokens, n_docs, id_sum)."""
    path = new_path(spark, "corpus")
    corpus.prepare(table(spark, d, "documents").select("doc_id", "text"), learned(spark, d), f"{path}/train", f"{path}/val", SHARD * 25, VAL)
    back = [shards.read_blocks(spark, f"{path}/{x}").withColumn("split", F.lit(x)) for x in ("train", "val")]
    return shard_sums(back[0].unionByName(back[1]), "split", "shard")


@query("snk_5_full")
def snk_5_full(spark, d):
    return corpus.rolled(encoded_lengths(spark, d), SHARD, VAL)


@query("win_1_full")
def win_1_full(spark, d):
    rows = corpus.rolled(encoded_lengths(spark, d), SHARD, VAL).where("split = 'train'").select("shard", F.col("n_tokens").alias("n"))
    return positioned(rows, ["shard"], ["n"]).select("shard", "n", F.col("before_n").alias("start"))


@query("win_3_full")
def win_3_full(spark, d):
    w = windows.windows(encoded_stream(spark, d), L, VOCAB_SIZE)
    check = F.expr("aggregate(zip_with(tokens, sequence(1, size(tokens)), (t, i) -> bigint(t) * i), 0L, (x, y) -> x + y)")
    return w.select("seq_idx", F.element_at("tokens", 1).alias("first"), F.element_at("tokens", -1).alias("last"), check.alias("checksum"))


@query("src_19_full")
def src_19_full(spark, d):
    total = F.aggregate("tokens", F.lit(0).cast("bigint"), lambda a, t: a + t)
    return windows.chunks(encoded_stream(spark, d), 10_000).select("chunk", F.size("tokens").alias("n"), total.alias("id_sum"))
