"""BPE, token files, language-model scores, tool calls and the pipeline."""

import base64
import hashlib
import json
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import awkward, frame, plain, prose
from pyspark.sql import functions as F

import corpus_pipeline
from catalign.llm import backoff_lm as B
from catalign.llm import bpe, decontaminate, langid, line_dedup, minhash, token_store, tool_calls

P = pytest.importorskip("public_tokenizers")
RANKS = P.path("byte_bpe_multi_50k.tiktoken")
HARD = [
    "", " ", "\n\n \t x", "don't WE'LL 've'", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "ab" * 3000, "\x1c\x1d \x85\xa0\u3000x",
    "Ünïcödé ÀÉÎ 😀😀 \U0010ffff", "1234567890 ⅷ²", "<|endoftext|>", "\r\n\r\n", "İıſK", "e\u0301e\u0301", "-----=====", "\u200b\ufeff", "中文字符測試" * 50,
]


def tiktoken_of():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def hard_texts():
    rng = random.Random(6)
    alphabets = ["abcdefgh", "aeiou nst", "éèçàüß xyz", "0123456789", "'s t!?.,- ", "жщюабв", "日本語テスト", "😀👍🏽‍\u0301\ufe0f"]
    return HARD + ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randrange(400))) for _ in range(400)]


def test_bpe_is_that_of_the_library():
    want, own = tiktoken_of(), bpe.BpeEncoder(bpe.read_ranks(RANKS), P.PATTERN)
    for text in hard_texts():
        ids, digits = own.encode(text)
        assert ids == want.encode_ordinary(text) and digits == ",".join(map(str, ids)) and own.decode(ids) == text.encode()


def test_bpe_of_a_small_vocabulary_steps_back():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"cd": 259, b"bcd": 260}
    own = bpe.BpeEncoder(ranks, ".+")
    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 12)))
        whole = [ranks[text.encode()]] if text.encode() in ranks else own.merge(text.encode())
        assert own.encode_piece(text.encode()) == whole


def test_bpe_of_a_table(spark):
    rows, want = awkward(9), tiktoken_of()
    docs = frame(spark, rows, clashing=True)
    expected = []
    for r in rows:
        ids = want.encode_ordinary(r[1] or "")
        text = hashlib.sha256((r[1] or "").encode()).hexdigest()
        expected.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), text))
    assert plain(bpe.round_trip(docs, RANKS, P.PATTERN)) == sorted(expected, key=repr)
    both = bpe.decode_documents(bpe.encode_documents(docs, RANKS, P.PATTERN, out="tokens"), RANKS, P.PATTERN, ids="tokens", out="back")
    assert both.filter(F.col("back") != F.coalesce("text", F.lit("")).cast("binary")).count() == 0 and "ids" in both.columns
    assert bpe.round_trip(frame(spark, []), RANKS, P.PATTERN).count() == 0


def test_encoded_and_checked_columns_replace_their_namesakes(spark):
    rows = awkward(10)
    docs = frame(spark, rows, clashing=True).withColumn("round_trip", F.lit("old"))
    got = bpe.encode_documents(docs, RANKS, P.PATTERN, check="round_trip")
    assert got.columns == [c for c in docs.columns if c not in ("ids", "round_trip")] + ["ids", "round_trip"] and "decoded" in got.columns
    want = tiktoken_of()
    assert plain(got.select("doc_id", "text", "ids", "round_trip")) == sorted(((r[0], r[1], want.encode_ordinary(r[1] or ""), True) for r in rows), key=repr)
    staged = corpus_pipeline.encode(spark, docs, "")
    assert staged.columns == got.columns and staged.filter("not round_trip").count() == 0


def test_an_encoder_goes_when_it_is_no_longer_used():
    import gc
    import weakref

    gc.disable()
    try:
        own = bpe.BpeEncoder({bytes([i]): i for i in range(256)}, ".+")
        own.encode("some text")
        gone = weakref.ref(own)
        del own
        assert gone() is None
    finally:
        gc.enable()


def test_a_full_memory_is_emptied(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_BYTES", 2000)
    want, own = tiktoken_of(), bpe.BpeEncoder(bpe.read_ranks(RANKS), P.PATTERN)
    for text in hard_texts()[:200]:
        assert own.encode(text)[0] == want.encode_ordinary(text)
    assert own.pieces.held <= 2000


WORD_BPE = P.path("word_bpe_49k.json")


def library_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD_BPE)
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_chunks_between_spaces_encode_like_the_whole_text():
    tokenizer, known = token_store._load(open(WORD_BPE, "rb").read())
    texts = hard_texts()
    assert [x.tolist() for x in token_store.encode_texts(texts, tokenizer, known)] == library_ids(texts)


def test_capitals_before_marks_encode_like_the_whole_text():
    tokenizer, known = token_store._load(open(WORD_BPE, "rb").read())
    marks = [chr(c) for c in range(0x300, 0x370)]
    texts = [f"A {letter}{mark} {letter}\u0327{mark}x\nABC" for letter in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for mark in marks]
    texts += ["J\u030c", "j\u030c J\u030c", "xJ\u030c ÉCOLE É", "H\u0331T\u0308 W\u030a\nY\u030a"]
    assert [x.tolist() for x in token_store.encode_texts(texts, tokenizer, known)] == library_ids(texts)
    assert token_store.encode_texts(["J\u030c"], tokenizer, known)[0].tolist() == [329, 136, 490]


def test_names_of_added_tokens_encode_as_the_library_does():
    tokenizer, known = token_store._load(open(WORD_BPE, "rb").read())
    texts = ["x <|endoftext|> y", "<|ENDOFTEXT|>", "a<|startoftext|>b\nC <|Startoftext|>", " <|endoftext|>\n<|endoftext|> ", "<|endoftext", "é<|endoftext|>J\u030c"]
    assert [x.tolist() for x in token_store.encode_texts(texts, tokenizer, known)] == library_ids(texts)
    assert token_store.encode_texts(texts[:1], tokenizer, known)[0].tolist() == [343, 49407, 344]


def test_words_and_their_marks_share_what_is_known():
    class Counted:
        """The library, with a count of the texts it is called for."""

        def __init__(self, tokenizer):
            self.tokenizer, self.calls = tokenizer, 0

        def encode_batch_fast(self, texts, **how):
            self.calls += len(texts)
            return self.tokenizer.encode_batch_fast(texts, **how)

        def __getattr__(self, name):
            return getattr(self.tokenizer, name)

    tokenizer, _ = token_store._load(open(WORD_BPE, "rb").read())
    counted, known = Counted(tokenizer), token_store.Memory(tokenizer)
    texts = ["thron, école. Thron! x1, it's; don't. a.. ,b, ...", "", " ", None, "\n,\n", ",", "thron; école", "J\u030c, x\u030c. \u030c,", "a\u00a0b, c\td."]
    texts += [f"word{''.join(chr(97 + int(c)) for c in str(i))}, é{chr(97 + i % 26)}." for i in range(3000)]
    assert [x.tolist() for x in token_store.encode_texts(texts, counted, known)] == library_ids(texts)
    assert counted.calls < 100
    calls = counted.calls
    token_store.encode_texts(["thron. école! worda; " * 50], counted, known)
    assert counted.calls - calls <= 2


@pytest.mark.parametrize("plane", ["byte", "bit"])
def test_planes_round_trip(plane):
    rng = np.random.default_rng(2)
    for count in (1, 7, 8, 9, 1000):
        ids = rng.integers(0, 2**32, count, dtype=np.uint64).astype(np.uint32)
        assert (token_store.unpack_chunk(token_store.pack_chunk(ids, plane), count) == ids).all()


@pytest.mark.parametrize("plane,part_bytes", [("byte", 1 << 24), ("bit", 4000)])
def test_files_give_back_every_document_in_order(spark, tmp_path, plane, part_bytes):
    rows = awkward(8)
    path = str(tmp_path / "tokens")
    token_store.write_tokens(
        frame(spark, rows, clashing=True), path, WORD_BPE, plane=plane, chunk_ids=64, segment_ids=500, part_bytes=part_bytes
    )
    encoded = [np.array([*ids, 1], "<u4") for ids in library_ids([r[1] for r in rows])]
    # Rows of one id stand in the order of their encoded form.
    order = sorted(zip((r[0] for r in rows), encoded), key=lambda x: (x[0] is not None, x[0] or 0, x[1].astype("<u2").tobytes()))
    want, at = [], 0
    for key, ids in order:
        want.append((key, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = token_store.token_digests(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert plain(got) == sorted(want, key=repr)
    back = {r.start: r.ids for r in token_store.read_tokens(spark, path).collect()}
    assert [back[w[1]] for w in want] == [ids.tolist() for _, ids in order]


def test_an_empty_table_makes_readable_files(spark, tmp_path):
    token_store.write_tokens(frame(spark, []), str(tmp_path / "none"), WORD_BPE)
    assert token_store.token_digests(spark, str(tmp_path / "none")).count() == 0


def brute_scores(rows, order, alpha=0.4, least=2):
    docs = [(r[0], (r[1] or "").encode().lower().split()) for r in rows]
    counts = Counter(tuple(w[i : i + n]) for _, w in docs for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(len(w) for _, w in docs)
    out = []
    for key, words in docs:
        score = 0.0
        for i in range(len(words)):
            for n in range(min(order, i + 1), 0, -1):
                gram = tuple(words[i - n + 1 : i + 1])
                if n == 1:
                    score += math.log10(counts[gram] / total)
                elif counts[gram] >= least:
                    score += math.log10(counts[gram] / counts[gram[:-1]])
                    break
                else:
                    score += math.log10(alpha)
        out.append((key, len(words), round(score, 6), round(score / len(words), 6) if words else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff_scores_against_brute_force(spark, order):
    rows = awkward(order + 20)
    got = B.score_documents(frame(spark, rows, clashing=True), order=order, block_bytes=2000, table_bytes=3000)
    fields = ["doc_id", "n_tokens", F.round("log10_score", 6).alias("s"), F.round("mean_log10", 6).alias("m")]
    assert [tuple(x or 0.0 if i == 2 else x for i, x in enumerate(r)) for r in plain(got.select(*fields))] == [
        tuple(x or 0.0 if i == 2 else x for i, x in enumerate(r)) for r in brute_scores(rows, order)
    ]


def test_counts_over_four_bytes_are_kept():
    values = np.array([0, 1, 2**32 - 1, 2**32, 2**40 + 7, 2**62], np.uint64)
    assert (B._unpack(B._pack(values)) == values).all() and len(B._unpack(B._pack(values[:0]))) == 0


def test_no_documents_have_no_scores(spark):
    assert B.score_documents(frame(spark, [])).count() == 0
    assert plain(B.score_documents(frame(spark, [(1, None, None, None, None)]))) == [(1, 0, 0.0, None)]


TOOLS = {"find": {"q": ("string", True), "n": ("integer", False), "opt": ("object", False)}, "stop": {}}
CALL, RESULT = "conv_id long, turn long, call_id string, name string, arguments string, role string", "conv_id long, turn long, call_id string, content string"


def linked(spark, calls, results):
    return {
        (r.conv_id, r.call_id, r.status): r
        for r in tool_calls.link_tool_calls(
            spark.createDataFrame([(*c, "x") for c in calls], CALL), spark.createDataFrame(results, RESULT), TOOLS
        ).collect()
    }


def test_calls_are_linked_ordered_and_canonical(spark):
    calls = [
        (1, 0, "a", "find", '{"q": "x", "opt": {"b": 1, "a": [1, 2.50]}}'),
        (1, 1, "b", "find", '{"n": 3, "q": "$a"}'),
        (1, 2, "c", "find", '{"q": "$b", "opt": {"x": "$a", "y": "$zz"}}'),
        (1, 9, "e", "find", '{"q": "$f"}'),
        (1, 9, "f", "find", '{"q": "$e"}'),
        (1, 9, "g", "find", '{"q": "$e"}'),
        (2, 0, "a", "stop", "{}"),
        (2, 0, "a", "stop", "{}"),
        (2, 3, "a", "find", "{}"),
        (3, 0, "late", "find", '{"q": "$early"}'),
        (3, 5, "early", "stop", "{}"),
    ]
    results = [(1, 1, "a", 'said "é"\n'), (1, 4, "a", "later"), (1, 3, "b", None), (2, 1, "zz", "lost"), (3, 6, "early", "")]
    got = linked(spark, calls, results)
    assert {k: r.level for k, r in got.items()} == {
        (1, "a", "linked"): 0, (1, "b", "linked"): 1, (1, "c", "unanswered"): 2, (1, "e", "cycle"): None, (1, "f", "cycle"): None,
        (1, "g", "cycle"): None, (2, "a", "unanswered"): 0, (2, "zz", "orphan"): None, (3, "late", "unanswered"): 1, (3, "early", "linked"): 0,
    }
    a = got[1, "a", "linked"]
    assert a.record == '{"arguments":{"opt":{"a":[1,2.5],"b":1},"q":"x"},"id":"a","name":"find","result":"said \\"é\\"\\n"}'
    assert json.loads(got[1, "b", "linked"].record)["result"] is None
    assert got[1, "c", "unanswered"].errors == "reference:zz" and got[2, "a", "unanswered"].copies == 2
    assert got[2, "zz", "orphan"].record == '{"id":"zz","result":"lost"}'
    assert json.loads(got[3, "early", "linked"].record)["result"] == ""


@pytest.mark.parametrize(
    "name,arguments,errors",
    [
        ("find", '{"q":"x"}', ""),
        ("find", '{"q":1,"n":"2","opt":[]}', "type:n,type:opt,type:q"),
        ("find", '{"n":2.5,"z":1}', "missing:q,type:n,unknown:z"),
        ("find", '{"q":null}', "type:q"),
        ("find", '{"q":"a","q":"b"}', "json"),
        ("find", "[1]", "json"),
        ("find", "{", "json"),
        ("find", None, "json"),
        ("other", "{}", "tool"),
        (None, "{}", "tool"),
        ("stop", "{}", ""),
        ("stop", '{"a":1}', "unknown:a"),
    ],
)
def test_arguments_are_validated(spark, name, arguments, errors):
    (row,) = linked(spark, [(1, 0, "a", name, arguments)], []).values()
    assert row.errors == errors and row.status == "unanswered" and json.loads(row.record)["id"] == "a"


def test_missing_identifiers_and_empty_tables(spark):
    calls = [(1, 0, None, "stop", "{}"), (1, 0, None, "stop", "{}"), (None, 0, "a", "stop", '{"q":"$a"}'), (1, None, "a", None, None)]
    rows = tool_calls.link_tool_calls(
        spark.createDataFrame([(*c, "x") for c in calls], CALL), spark.createDataFrame([(1, 0, None, "r"), (None, 1, "a", "r")], RESULT), TOOLS
    ).collect()
    assert sorted((str(r.conv_id), str(r.call_id), r.status) for r in rows) == [
        ("1", "None", "orphan"), ("1", "None", "unanswered"), ("1", "None", "unanswered"), ("1", "a", "unanswered"),
        ("None", "a", "orphan"), ("None", "a", "unanswered"),
    ]
    assert linked(spark, [], []) == {}


def test_no_python_runs_in_the_plan(spark):
    calls = spark.createDataFrame([(1, 0, "a", "find", '{"q":"$b"}', "x")], CALL)
    plan = tool_calls.link_tool_calls(calls, spark.createDataFrame([], RESULT), TOOLS)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))


def pipeline_rows():
    rng = random.Random(13)
    heads = {"aa": ["ta", "ri", "ko", "ma"], "bb": ["sch", "ung", "ver", "ich"]}
    rows = []
    for i in range(400):
        lang = rng.choice(list(heads))
        line = lambda: " ".join("".join(rng.choice(heads[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(8, 30)))  # noqa: B023, E731
        rows.append((i, "\n".join(line() for _ in range(rng.randrange(1, 5))), lang, "s", 0))
    rows += [(1000 + i, rows[i][1], rows[i][2], "copy", 0) for i in range(10)]
    rows += [(1100 + i, rows[i][1].replace("\n", " ") + " taxy", rows[i][2], "near", 0) for i in range(10)]
    rows += [(1200, "12 34", None, "s", 0), (1201, None, None, "s", 0), (1202, "", None, "s", 0)]
    return rows, [rows[50][1], rows[51][1].split("\n")[0]]


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    rows, items = pipeline_rows()
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language id", "line dedup", "near dedup", "decontamination", "byte-level bpe"] and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    made = [docs]
    for name, function in corpus_pipeline.STAGES:
        function(spark, made[-1], str(tmp_path)).write.parquet(str(tmp_path / "out" / name))
        made.append(spark.read.parquet(str(tmp_path / "out" / name)))
    assert all(m.columns == columns for m in made[1:-1])
    kept = {r.doc_id: r.text for r in made[1].collect()}
    model = langid.train(docs)
    judged = {r.doc_id: r.rejected for r in langid.predict(docs, model).collect()}
    assert set(kept) == {i for i, gone in judged.items() if not gone} and not {1200, 1201, 1202} & set(kept) and len(kept) > 400
    lines = {r.doc_id: r.text for r in made[2].collect()}
    gone = {tuple(r) for r in line_dedup.repeated_lines(made[1]).collect()}
    cut = {i: [x for n, x in enumerate(t.split("\n")) if (i, n) not in gone] for i, t in kept.items()}
    assert lines == {i: "\n".join(t) for i, t in cut.items() if t} and not {1000 + i for i in range(10)} & set(lines)
    near = {r.doc_id for r in made[3].collect()}
    assert near == {r.doc_id for r in minhash.near_duplicates(made[2]).collect() if r.kept}
    clean = {r.doc_id for r in made[4].collect()}
    hit = {r.doc_id for r in decontaminate.find_contamination(made[3], spark.read.parquet(str(tmp_path / "benchmark.parquet"))).collect() if r.n_hit}
    assert clean == near - hit and {50, 51} & near and not {50, 51} & clean
    want = tiktoken_of()
    final = made[5].collect()
    assert {r.doc_id: r.ids for r in final} == {i: want.encode_ordinary(lines[i]) for i in clean} and all(r.round_trip for r in final)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert plain(whole.select("doc_id", "text")) == plain(made[5].select("doc_id", "text"))


def test_vocabulary_file_is_read():
    line = open(RANKS, "rb").readline().split()
    assert bpe.read_ranks(RANKS)[base64.b64decode(line[0])] == int(line[1])


def test_few_documents_are_in_a_batch_in_every_stage(spark, monkeypatch, tmp_path):
    import corpus_pipeline

    from catalign.llm.common import DOC_ROWS

    seen, name = [], "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)

    def watched(spark, docs, sf_dir):
        def sizes(batches):
            import pyarrow as pa

            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["doc_id"])

        seen.append(1)
        return docs.select("doc_id").mapInArrow(sizes, "doc_id bigint")

    spark.range(3 * DOC_ROWS).withColumnRenamed("id", "doc_id").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("watched", watched)])
    got = [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert seen and sum(got) == 3 * DOC_ROWS and max(got) <= DOC_ROWS
    assert spark.conf.get(name) == before
