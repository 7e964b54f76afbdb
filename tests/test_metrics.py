"""Metrics: hand-computed goldens, brute force, and invariance of sums."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from babelgauge.functions import overlap
from babelgauge.functions.text import chrf_words, strip, tokens_13a
from babelgauge.operators.quality import (Meteor, evaluate, metric, metrics, row_statistics, scores, sum_statistics)
from babelgauge.operators.vocabulary import canonical_tokens
from tests import brute

ALL = ["sacrebleu", "spBleu", "chrf", "chrfpp", "meteor"]
CHAR = {"spBleu": {"tokenize": "char"}}


def table(spark, pairs):
    return spark.createDataFrame([(i, h, r) for i, (h, r) in enumerate(pairs)], "id long, prediction string, reference string")


def score(spark, pairs, names=ALL):
    return evaluate(table(spark, pairs), metrics(names, **CHAR)).first().asDict()


def messy(seed, n=60):
    rng = random.Random(seed)
    words = ["the", "The", "cat", "cats", "sat,", "(on)", "mat.", "3.14", "1,000-2", "a&amp;b", "é ê", "x-\ny", "\"q\"",
             "...", "-", "<skipped>", "中文", "😀!", "don't", "a_b", "end-", "5-6"]
    text = lambda: rng.choice(["", " ", "\n"]) + " ".join(rng.choice(words) for _ in range(rng.randint(0, 25)))
    return [(text(), text()) for _ in range(n)]


def test_perfect_pair(spark):
    got = score(spark, [("a b c d e f g h", "a b c d e f g h")])
    assert got["sacrebleu"] == 100.00000000000004
    assert got["meteor"] == 0.9990234375
    assert got["chrf"] == pytest.approx(100) and got["chrfpp"] == pytest.approx(100)


@pytest.mark.parametrize("pair", [("x y z w v", "a b c d e"), ("", "a b c d")])
def test_nothing_in_common(spark, pair):
    got = score(spark, [pair])
    assert (got["sacrebleu"], got["meteor"], got["chrf"], got["chrfpp"]) == (0, 0, 0, 0)


def test_short_pair_scores_no_bleu(spark):
    assert score(spark, [("a b c", "a b c")])["sacrebleu"] == 0


def test_smoothing_halves_per_empty_order(spark):
    got = score(spark, [("a x b y c", "c q a r b")])["sacrebleu"]
    expected = (100 * 3 / 5 * 100 / (2 * 4) * 100 / (4 * 3) * 100 / (8 * 2)) ** 0.25
    assert got == pytest.approx(expected)


def test_matches_are_clipped(spark):
    df = table(spark, [("the the the", "the cat")])
    counted = df.select(overlap.token_overlap(F.split("prediction", " "), F.split("reference", " "), 2)).first()[0]
    assert counted == [1, 0, 3, 2]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    pairs = [(h.strip(), r.strip()) for h, r in messy(seed)]
    got = score(spark, pairs)
    assert got["sacrebleu"] == pytest.approx(brute.bleu(pairs))
    assert got["spBleu"] == pytest.approx(brute.bleu(pairs, lambda t: [c for c in t if not c.isspace()]))
    assert got["chrf"] == pytest.approx(brute.chrf(pairs))
    assert got["chrfpp"] == pytest.approx(brute.chrf(pairs, 2))
    assert got["meteor"] == pytest.approx(brute.meteor(pairs))


def test_tokenisers_against_brute_force(spark):
    texts = [t for pair in messy(3) for t in pair]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(tokens_13a(F.col("t")), chrf_words(F.col("t")), strip(F.col("t"))).collect()
    for text, (a, b, c) in zip(texts, got):
        assert (a, b, c) == (brute.tokens_13a(text), brute.chrf_words(text), text.strip())


def test_overflow_guard_renumbers(spark):
    """Large alphabets take the re-numbering path and give the same counts."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60000)]
    pairs = [(" ".join(rng.choices(vocabulary, k=3000)), " ".join(rng.choices(vocabulary, k=3000))) for _ in range(20)]
    pairs = [(h, h[:9000] + r) for h, r in pairs]
    assert len({w for p in pairs for t in p for w in t.split()}) ** 4 * len(pairs) * 2 >= 1 << 62
    assert score(spark, pairs, ["sacrebleu"])["sacrebleu"] == pytest.approx(brute.bleu(pairs))


def test_slices_do_not_change_counts(monkeypatch):
    import pyarrow as pa

    pairs = messy(7)
    h, r = (pa.array([p[i] for p in pairs]) for i in (0, 1))
    whole = overlap._counts(*overlap._character_sides(h, r), 6).to_pylist()
    monkeypatch.setattr(overlap, "SLICE", 40)
    pieces = list(overlap._pieces(h, r))
    assert len(pieces) > 5
    assert overlap._joined([overlap._counts(*overlap._character_sides(*p), 6) for p in pieces]).to_pylist() == whole


def test_bleu_and_meteor_split_texts_once(spark):
    """Together they are one function of the texts and score as they do alone; with stems METEOR keeps its own."""
    pairs = messy(11) + [("", "a"), (None, "b"), ("c", None)]
    together = score(spark, pairs, ["sacrebleu", "meteor"])
    for name in ("sacrebleu", "meteor"):
        assert together[name] == score(spark, pairs, [name])[name]
    text = row_statistics(table(spark, pairs), metrics(["sacrebleu", "meteor"]))._jdf.queryExecution().toString()
    assert "overlap_and_alignment_udf" in text and " alignment_udf" not in text and "token_overlap_udf" not in text
    stems = [metric("sacrebleu"), Meteor(stem=True)]
    alone = evaluate(table(spark, pairs), stems[1:]).first()["meteor"]
    assert evaluate(table(spark, pairs), stems).first()["meteor"] == alone


def test_equal_keys_are_paired_in_order():
    rng = np.random.default_rng(4)
    for scale in (1, 1 << 55):
        for _ in range(50):
            hyp, ref = (rng.integers(0, 6, rng.integers(0, 20)) * scale for _ in range(2))
            want = set()
            for key in set(hyp.tolist()) & set(ref.tolist()):
                want |= set(zip(np.flatnonzero(hyp == key).tolist(), np.flatnonzero(ref == key).tolist()))
            at, to = overlap._paired(hyp, ref)
            assert len(set(at.tolist())) == len(at) and set(zip(at.tolist(), to.tolist())) == want


def test_memory_does_not_grow_with_the_batch():
    import tracemalloc

    import pyarrow as pa

    text = pa.array([" ".join(f"w{i * j % 977}" for j in range(2000)) for i in range(1500)])  # 9 MB on each side

    def most(rows):
        tracemalloc.start()
        for piece in overlap._pieces(text.slice(0, rows), text.slice(0, rows)):
            overlap._counts(*overlap._character_sides(*piece), 6)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return peak

    assert most(1500) < 1.3 * most(500)


def test_meteor_stages(spark):
    pairs = [(h.strip(), r.strip()) for h, r in messy(11)]
    stem = lambda token: token[:-1] if token.endswith("s") else token
    df = table(spark, pairs).withColumn("h", tokens_13a(F.col("prediction"))).withColumn("r", tokens_13a(F.col("reference")))
    mapping = spark.createDataFrame([("cats", "cat")], "token string, canonical string")
    staged = canonical_tokens(df, "id", ["h", "r"], mapping)
    got = evaluate(staged, [Meteor(stages=(("h_canonical", "r_canonical"),))]).first()[0]
    assert got == pytest.approx(brute.meteor(pairs, (str, stem)))
    assert got > brute.meteor(pairs)


def test_order_and_partitioning_do_not_matter(spark):
    df = table(spark, messy(4))
    one = evaluate(df.coalesce(1), metrics(["sacrebleu", "chrf"])).first()
    many = evaluate(df.repartition(7).orderBy(F.rand()), metrics(["sacrebleu", "chrf"])).first()
    assert one == many


def test_sums_over_a_split_equal_the_whole(spark):
    df = table(spark, messy(6)).withColumn("part", F.col("id") % 3)
    chosen = metrics(["sacrebleu", "chrfpp"])
    parts = sum_statistics(row_statistics(df, chosen, ["part"]), ["part"])
    assert scores(sum_statistics(parts.drop("part")), chosen).first() == evaluate(df, chosen).first()


def test_registry():
    for name in ("comet", "rouge", "nonsense", "spBleu"):
        with pytest.raises(ValueError):
            metric(name)
    assert metric("chrf++").word_order == 2


def test_sentencepiece_model(spark, tmp_path):
    sentencepiece = pytest.importorskip("sentencepiece")
    corpus = tmp_path / "text.txt"
    corpus.write_text("\n".join("the cat sat on the mat and the dog ran" for _ in range(50)))
    sentencepiece.SentencePieceTrainer.train(input=str(corpus), model_prefix=str(tmp_path / "m"), vocab_size=30,
                                             hard_vocab_limit=False, minloglevel=2)
    pairs = table(spark, [("the cat sat on the mat", "the cat sat on the mat"), ("the dog", "the cat ran")])
    path = str(tmp_path / "m.model")
    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    got = evaluate(pairs, [metric("spBleu", tokenize=f"spm:{path}")]).first()[0]
    expected = brute.bleu([(r.prediction, r.reference) for r in pairs.collect()],
                          lambda t: processor.encode(t, out_type=str))
    assert got == pytest.approx(expected)


def test_byte_rules_are_the_tokenisers(spark):
    """Texts split by byte classes give the tokens of the column expressions, whatever stands next to what."""
    import pyarrow as pa

    from babelgauge.functions import overlap
    from babelgauge.functions.text import SPACE_CHARACTERS, chrf_words, tokens_13a

    draw = random.Random(7)
    signs = [*"ab01..,,--<>&;'\"!/ \n", "é", "中", "😀", " ", " ", "　", "\x85", "\x1c", "&quot;", "<skipped>", "-\n", "&amp;lt;"]
    texts = [None, "", " ", ".", "1", "-", "1.", ".1", "1-", "1,000.5", "..,.5", "0..,.5", "a-\nb", *SPACE_CHARACTERS,
             *("".join(draw.choices(signs, k=draw.randint(1, 12))) for _ in range(4000))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").coalesce(1)
    for rule, expression in (("13a", tokens_13a), ("chrf", chrf_words)):
        want = [list(r.w or []) for r in df.select("i", expression(F.col("t")).alias("w")).orderBy("i").collect()]
        for array in (pa.array(texts, pa.string()), pa.array(["1.,", *texts], pa.large_string()).slice(1)):
            tokens, lengths = overlap._split(array, rule)
            ends = np.append(0, np.cumsum(lengths))
            got = [tokens[int(a):int(b)].to_pylist() for a, b in zip(ends, ends[1:])]
            assert got == want, next((t, g, w) for t, g, w in zip(texts, got, want) if g != w)


def test_grams_of_all_orders_from_one_sort():
    """Equal to a sort for every order, where the gram fits a number and where it does not."""
    from babelgauge.functions import overlap

    rng = np.random.default_rng(3)
    for trial in range(300):
        rows, alphabet, orders = int(rng.integers(0, 6)), int(rng.choice([1, 2, 60, 3000, 1 << 20])), int(rng.choice([1, 2, 4, 6]))
        sides = []
        for _ in range(2):
            lengths = rng.integers(0, 60, rows)
            sides.append(overlap.Side(rng.integers(0, alphabet, lengths.sum()), lengths))
        assert (overlap._clipped(*sides, alphabet, orders) == overlap._clipped_by_order(*sides, alphabet, orders)).all()


def test_texts_are_split_where_they_are_compared(spark):
    """No token list goes to the workers, and one pass over the characters serves all orders."""
    df = spark.createDataFrame([("a b c d, e", "a b c x, e")], "prediction string, reference string")
    plan = evaluate(df, metrics(["sacrebleu", "spBleu", "chrf", "chrf++", "meteor"], spBleu={"tokenize": "char"})) \
        ._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "regexp_replace" not in plan
    assert len(set(re.findall(r"character_overlap_udf\([^)]*\)#\d+", plan))) == 1


def test_short_and_long_words_are_cut_alike():
    from babelgauge.functions import subwords

    rng = np.random.default_rng(5)
    ranks = {bytes([i]): i for i in range(256)}
    for n in range(2, 6):
        for _ in range(60):
            ranks.setdefault(bytes(rng.choice(list(b"abc "), n).tolist()), len(ranks))
    for _ in range(500):
        word = bytes(rng.choice(list(b"abcd "), rng.integers(1, 40)).tolist())
        assert subwords._cut_short(word, ranks) == subwords._cut_long(word, ranks)


def test_pieces_are_cut_in_the_overlap_pass(spark, tmp_path):
    """Ranks give BLEU the same counts as a column of pieces, and METEOR still has its column."""
    import base64

    from babelgauge.functions.subwords import subword_tokenizer

    ranks = [bytes([i]) for i in range(256)] + [b" a", b"ab", b" ab", b"cab"]
    path = tmp_path / "few.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(p) + b" %d\n" % i for i, p in enumerate(ranks)))
    draw = random.Random(3)
    df = table(spark, [("".join(draw.choices("abc  ", k=draw.randint(0, 30))), "".join(draw.choices("abc  ", k=20))) for _ in range(60)])
    split = subword_tokenizer(str(path))
    for kind in ("spBleu", "meteor"):
        one, other = (evaluate(df, [metric(kind, tokenize=how)], ["id"]).orderBy("id").collect() for how in (f"ranks:{path}", split))
        assert [r[1] for r in one] == [r[1] for r in other]
    assert "subwords" not in evaluate(df, [metric("spBleu", tokenize=f"ranks:{path}")])._jdf.queryExecution().optimizedPlan().toString()
