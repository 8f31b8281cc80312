"""One registered query for each operator, over whole tables, and SQL where it can say the same."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, decontaminate, extract, langid, lexical, phrases, repeats, secrets, simhash, spelling, suffix, toxicity
from .frames import read, slices, texts

#: The tokenizer of op10; its file stays where it is installed.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

#: Seeds of two finer categories, which the labels do not tell apart. Fixed values.
INSULTS = ("idiot", "moron", "stupid", "clown", "loser")
CONTEMPT = ("trash", "scum", "disgusting", "worthless", "pathetic")


def _categories() -> dict:
    """Chain order: the finer categories first, as weak labels, then the label itself."""
    toxic = F.col("toxic") == 1

    def any_of(seeds):
        return toxic & F.col("text").rlike(rf"(?i)\b({'|'.join(seeds)})\b")

    return {"insult": any_of(INSULTS), "contempt": any_of(CONTEMPT), "toxic": toxic}


def toxicity_chain(docs: DataFrame, sf_dir: str) -> toxicity.Chain:
    return toxicity.train(docs, read(docs.sparkSession, sf_dir, "labels"), _categories())


def op2_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, p_insult, p_contempt, p_toxic, toxic`` for each row of ``documents``."""
    docs = read(spark, sf_dir, "documents")
    chain = toxicity_chain(docs, sf_dir)
    p = docs.select(F.col("doc_id").cast("long"), toxicity.score(chain, F.col("text")).alias("p"))
    columns = [F.col("p")[i].alias(f"p_{c}") for i, c in enumerate(chain.categories)]
    return p.select("doc_id", *columns, (F.col("p")[2] >= chain.thresholds[2]).alias("toxic"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents"))
    base = [r.kind for r in secrets.BASE]

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    def of(kinds):
        return F.filter("spans", lambda s: s.kind.isin(kinds))

    return found.select(
        "doc_id",
        *(F.size(of([k])).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(joined(of(base)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op5_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=4, max_bits=4)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of conversations, read back as written: roles and texts from the turns, what is trained
    from the examples, each of which must begin with all that was written before its reply."""
    odd = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame(
        [(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string"
    )
    table = read(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text"
    )
    turns = chat.render(table.unionByName(own))
    schema = (
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long, n_examples long, example_chars long"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, context = None, None, 0
        done: list[tuple] = []

        def close() -> None:
            n, turns_, loss, loss_n, chars, n_examples, example_chars = state
            done.append((conv, n, turns_.hexdigest(), loss_n, loss.hexdigest(), chars, n_examples, example_chars))

        def flush() -> pa.RecordBatch:
            columns = [list(c) for c in zip(*done)] or [[]] * 8
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 3]
            done.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in schema.split(", ")]
            )

        for batch in batches:
            for row in batch.to_pylist():
                if state is None or row["conv_id"] != conv:
                    if state is not None:
                        close()
                    conv, state = row["conv_id"], [0, hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0]
                if row["context_end"] is None:
                    role, text = chat.read_turn(row["piece"])
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    context, state[4] = state[4], state[4] + len(row["piece"])
                    continue
                if (row["context_end"], row["example_end"]) != (context, state[4]):
                    raise ValueError("an example does not begin with the turns before its reply")
                a, b = row["loss_start"] - row["context_end"], row["loss_end"] - row["context_end"]
                trained = chat.unescape(row["piece"][a:b])
                state[2].update(trained.encode())
                state[3] += len(trained)
                state[5] += 1
                state[6] += row["example_end"]
            yield flush()
        if state is not None:
            close()
        yield flush()

    in_order = chat.expanded(turns).sortWithinPartitions("conv_id", "position", F.col("context_end").asc_nulls_first())
    return in_order.mapInArrow(run, schema)


_WRITTEN = "replace(replace({}, chr(92), repeat(chr(92), 2)), '|', chr(92) || 'p')"

OP7_SQL = f"""
WITH all_turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', chr(92) || '### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', chr(92) || '### Assistant: </turn> ok'
), sized AS (
    SELECT *, length({_WRITTEN.format("role")}) + length({_WRITTEN.format("text")}) + 11 AS chars FROM all_turns
), ended AS (
    SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM sized
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(chars) AS BIGINT) AS formatted_chars,
    count(*) FILTER (role = 'assistant') AS n_examples,
    CAST(coalesce(sum(upto) FILTER (role = 'assistant'), 0) AS BIGINT) AS example_chars
FROM ended GROUP BY conv_id
"""


def op1_one_bit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ann.usable(read(spark, sf_dir, "embeddings"))
    return ann.nearest(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k=20)


OP1_SQL = """
WITH kept AS (
    SELECT vec_id, min(embedding::DOUBLE[]) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    GROUP BY vec_id
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v) AS score
    FROM kept q JOIN kept c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM scored
)
SELECT * FROM ranked WHERE rank <= 20
"""


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all pages and documents, ``doc_id`` or ``page_id`` filled."""
    documents = read(spark, sf_dir, "documents")
    model = langid.train(documents)
    pages = langid.from_pages(read(spark, sf_dir, "pages"))
    own = langid.from_documents(documents)
    return langid.identify(pages.unionByName(own), model)


def _kept_digest(words: bool, window: int, column: str) -> tuple[str, Callable]:
    """Schema and function from rows of ``repeats.with_ranges`` to the digest of what is kept."""
    fields = f"doc_id long, {column} long, n_removed long, " + ("" if words else "n_spans long, ") + "kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            size, removed, spans, digest = [], [], [], []
            for row in batch.to_pylist():
                raw = row["text"].encode()
                units = raw.split() if words else raw
                n = len(units)
                whole = row["doc_id"] != row["rep_id"] if words else row["copies"] > 1
                cut: list[list[int]] = []
                for r in row["ranges"] or ():
                    if cut and r["start"] <= cut[-1][1]:
                        cut[-1][1] = max(cut[-1][1], r["end"])
                    else:
                        cut.append([r["start"], r["end"]])
                if whole and n >= window:
                    cut = [[0, n]]
                ends = [0, *(b for _, b in cut)]
                parts = [units[a:b] for a, b in zip(ends, [*(a for a, _ in cut), n])]
                kept = b" ".join(w for p in parts for w in p) if words else b"".join(parts)
                size.append(n)
                removed.append(sum(b - a for a, b in cut))
                spans.append(len(cut))
                digest.append(hashlib.sha256(kept).hexdigest())
            numbers = [size, removed] if words else [size, removed, spans]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in numbers), pa.array(digest, pa.string())],
                [f.split()[0] for f in fields.split(", ")],
            )

    return fields, run


def op8_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeats.keyed(read(spark, sf_dir, "documents"))
    fields, run = _kept_digest(False, 200, "n_bytes")
    return repeats.with_ranges(rows, suffix.covered(rows, window=200)).mapInArrow(run, fields)


def op9_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeats.keyed(read(spark, sf_dir, "documents"))
    fields, run = _kept_digest(True, 20, "n_words")
    return repeats.with_ranges(rows, phrases.covered(rows, window=20)).mapInArrow(run, fields)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of what they decode to, in one pass over the texts."""
    spec = bpe.vocabulary(TOKENIZER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.WordBpe(spec)
        for batch in slices(batches, limit=bpe.BATCH):
            ids = model.encode_batch(texts(batch))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(map(len, ids), pa.int64()),
                    pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(model.decode(x).encode()).hexdigest() for x in ids], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op11_dense_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=20)


_TERMS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)

OP11_SQL = f"""
WITH docs AS (
    SELECT row_number() OVER () AS d, doc_id, {_TERMS} AS terms FROM documents
), totals AS (
    SELECT count(*) AS docs, sum(len(terms))::BIGINT AS terms FROM docs WHERE len(terms) > 0
), held AS (
    SELECT d, doc_id, len(terms) AS n, unnest(terms) AS term FROM docs
), tf AS (
    SELECT d, doc_id, n, term, count(*) AS tf FROM held GROUP BY ALL
), weights AS (
    SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
    FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), totals
), items AS (
    SELECT row_number() OVER () AS i, item_id, {_TERMS} AS terms FROM benchmark
), asked AS (
    SELECT i, item_id, term, count(*) AS repeats FROM (SELECT i, item_id, unnest(terms) AS term FROM items) GROUP BY ALL
), scored AS (
    SELECT i, item_id, d, doc_id,
        sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // totals.terms))))::BIGINT AS score
    FROM asked JOIN tf USING (term) JOIN weights USING (term), totals GROUP BY ALL
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank
    FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""


def op12_permuterm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"), min_length=7, min_count=2, noise=31, ratio=10)


OP12_SQL = """
WITH RECURSIVE steps AS (
    SELECT list(list_reduce([i, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, x: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY i) AS step
    FROM range(256) r(i)
), runs AS (
    SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
    FROM documents
), counted AS (
    SELECT d, run, count(*) AS times, hex(encode(d || ':' || run)) AS digits FROM runs WHERE length(run) >= 7 GROUP BY ALL
), hashed AS (
    SELECT run, times, xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(range(length(digits) // 2), lambda i: ('0x' || digits[2 * i + 1 : 2 * i + 2])::BIGINT)),
        lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1]))) AS h
    FROM counted, steps
), spelled AS (
    SELECT times, CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
    FROM hashed
), words AS (
    SELECT word, sum(times)::BIGINT AS n FROM spelled WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2
), shorter AS (
    SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest
    FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
    SELECT a.word AS word, b.word AS other FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT s.word, w.word FROM shorter s JOIN words w ON s.rest = w.word
    UNION SELECT w.word, s.word FROM shorter s JOIN words w ON s.rest = w.word
), best AS (
    SELECT near.word, count(*) AS n_near, max(o.n) AS best_n, arg_max(near.other, (o.n, -r.place)) AS best
    FROM near JOIN words o ON o.word = near.other
    JOIN (SELECT word, row_number() OVER (ORDER BY encode(word)) AS place FROM words) r ON r.word = near.other
    GROUP BY near.word
), formed AS (
    SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.best_n >= 10 * w.n THEN b.best END AS form,
        CASE WHEN b.best_n >= 10 * w.n THEN b.best_n END AS form_n
    FROM words w LEFT JOIN best b USING (word)
), chain AS (
    SELECT word, word AS at FROM formed
    UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NOT NULL
), ends AS (
    SELECT c.word, c.at AS root FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NULL
)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM formed f JOIN ends e USING (word)
"""


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return extract.extract(pages, extract.train(pages))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_one_bit_codes": op1_one_bit_codes,
    "op2_toxicity_chain": op2_toxicity_chain,
    "op3_language": op3_language,
    "op4_secret_scan": op4_secret_scan,
    "op5_simhash_trie": op5_simhash_trie,
    "op6_decontaminate": op6_decontaminate,
    "op7_prefix_targets": op7_prefix_targets,
    "op8_suffix_tree": op8_suffix_tree,
    "op9_phrase_automata": op9_phrase_automata,
    "op10_bpe": op10_bpe,
    "op11_dense_tiles": op11_dense_tiles,
    "op12_permuterm": op12_permuterm,
    "op13_main_text": op13_main_text,
}
#: The other queries have no SQL that could run on whole tables; tests hold them against brute force.
ORACLE: dict[str, str] = {
    "op1_one_bit_codes": OP1_SQL,
    "op7_prefix_targets": OP7_SQL,
    "op11_dense_tiles": OP11_SQL,
    "op12_permuterm": OP12_SQL,
}
