"""The text operators against brute force, exact round trips and held-out labels, and on odd rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import SF
from wavespan.llm import edits, licenses, media, packing, pitman_yor, queries, rules, simhash, tokens, toxicity
from wavespan.llm import quality as subwords
from wavespan.llm.common import id_remainder

ODD = [(1, None), (2, ""), (3, "  two  spaces "), (3, "  two  spaces "), (None, "no id here at all"), (5, "word " * 3000), (6, "Licensed under CC BY-NC 4.0."), (7, "a\x00b▁c\x1c d\n e"), (8, "ü" * 9000)]
SCHEMA = "doc_id long, text string"
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
PIECE_BITS = st.text(alphabet=" \n\tabcé!1▁'s \x1c\x85　😀ﬁ", max_size=24)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).selectExpr("doc_id", "text", "1 AS label", "'x' AS fp", "2L AS component_id", "3L AS length")


@pytest.fixture(scope="module")
def texts():
    return pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id")["text"].to_dict()


def run(spark, name):
    return queries.queries()[name](spark, SF).toPandas()


@pytest.fixture(scope="module")
def byte_model():
    return tokens.Bytes(tokens.tokenizer_path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECE_BITS, min_size=1, max_size=4))
def test_words_encode_as_the_libraries_do(some):
    model, pieces = tokens.byte_model(tokens.tokenizer_path("byte_bpe_50k.json")), tokens.piece_model(tokens.tokenizer_path("piece_bpe_32k.model"))
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    for text, raw, (n, ids, back) in zip(some, model.ids(some), pieces.encode_decode(some), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
        want = pieces.model.encode(text)
        assert (n, ids.decode(), back) == (len(want), ",".join(map(str, want)), pieces.model.decode(want))


def test_table_that_overflows_gives_the_same_ids(library):
    model = tokens.Bytes(tokens.tokenizer_path("byte_bpe_50k.json"), limit=5)
    some = ["one two three four five six seven", "seven eight nine ten", "one two"]
    assert [np.frombuffer(r, "<u4").tolist() for r in model.ids(some)] == [library(t) for t in some]


@settings(max_examples=150, deadline=None)
@given(PIECE_BITS, st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30), PIECE_BITS), max_size=4))
def test_edited_counts(text, todo):
    model = tokens.byte_model(tokens.tokenizer_path("byte_bpe_50k.json"))
    text = text * 9
    parts = tokens.pre_tokens(text)
    tree = edits.TokenTree(model, parts, model.counts(parts))
    for a, b, new in todo:
        tree.edit(a, b, new)
        a = min(a, len(text))
        text = text[:a] + new + text[max(a, min(b, len(text))) :]
        assert tree.text() == text
        assert tree.tokens == len(model.ids([text])[0]) // 4


def test_packing(spark, texts, library, odd):
    got = run(spark, "op3_best_fit_packing")
    for doc_id, own in got.sort_values("piece").groupby("doc_id"):
        ids, at = np.array([*library(texts[doc_id]), 0], "<u4"), 0
        for r in own.itertuples():
            assert (r.start, r.ids_crc32) == (at, zlib.crc32(ids[at : at + r.length].tobytes()))
            assert r.length == 2048 or r.piece == 0
            at += r.length
        assert at == len(ids)
    assert set(got["doc_id"]) == set(texts)
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *np.cumsum(own["length"])[:-1]]
        assert own["length"].sum() <= 2048
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 2048) + 1
    assert packing.pack(packing.token_pieces(odd, tokens.tokenizer_path("byte_bpe_50k.json"))).filter("piece = 0").count() == len(ODD)
    assert packing.pack(packing.token_pieces(odd.limit(0), tokens.tokenizer_path("byte_bpe_50k.json"))).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab1'st.!éß中😀", min_size=1, max_size=20), st.lists(st.tuples(st.integers(0, 90), st.integers(0, 90), st.text(alphabet="a1's ", max_size=6)), max_size=4))
def test_edited_counts_without_spaces(text, todo):
    model = tokens.byte_model(tokens.tokenizer_path("byte_bpe_50k.json"))
    text = text * 9
    parts = tokens.pre_tokens(text)
    tree = edits.TokenTree(model, parts, model.counts(parts))
    for a, b, new in todo:
        tree.edit(a, b, new)
        a = min(a, len(text))
        text = text[:a] + new + text[max(a, min(b, len(text))) :]
        assert tree.text() == text and tree.tokens == len(model.ids([text])[0]) // 4


def test_an_edit_encodes_what_it_touches():
    model = tokens.byte_model(tokens.tokenizer_path("byte_bpe_50k.json"))
    for text in ("ab12!?" * 2000, "some words and more " * 800):
        parts = tokens.pre_tokens(text)
        tree = edits.TokenTree(model, parts, model.counts(parts))
        before = tree.encoded
        tree.edit(5000, 5003, "xy")
        assert len(parts) > 2000 and tree.encoded - before < 12 and tree.root.depth < 14


def test_token_count_query(spark, texts, library, odd):
    def after(text):
        n = len(text)
        third = n // 3
        cut = min(40, n - third)
        text = text[:third] + text[third + cut :]
        middle = (n - cut) // 2
        text = text[:middle] + " an edited passage " + text[middle:]
        return text[: max(len(text) - 10, 0)] + "\nThe end."

    got = run(spark, "op4_token_counts").set_index("doc_id")
    for doc_id, text in texts.items():
        assert (got["n_tokens"][doc_id], got["n_tokens_edited"][doc_id]) == (len(library(text)), len(library(after(text))))
    path = tokens.tokenizer_path("byte_bpe_50k.json")
    assert edits.edited_token_counts(queries.edits_of(odd), path).count() == len(ODD)
    assert edits.edited_token_counts(queries.edits_of(odd.limit(0)), path).count() == 0


def test_piece_query(spark, texts, odd):
    path = tokens.tokenizer_path("piece_bpe_32k.model")
    model = tokens.piece_model(path).model
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    got = run(spark, "op7_sentencepiece").set_index("doc_id")
    for doc_id, text in texts.items():
        ids = model.encode(text)
        assert tuple(got.loc[doc_id, ["n_tokens", "ids_sha256", "decoded_sha256"]]) == (len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids)))
    assert tokens.piece_digest(odd.limit(0), path).count() == 0


@pytest.mark.parametrize(("low", "high", "n"), [(205, 1024, 600), (500, 900, 600), (300, 1500, 800)])
def test_evolution_needs_fewer_sequences_than_best_fit(low, high, n):
    lengths = np.random.default_rng(5).integers(low, high, n)
    own = packing.Packer(lengths, 2048, 1)
    best_fit = own.best_fit(own.falling(list(range(n))))
    population = own.first()
    for _ in range(packing.EPOCHS):
        population = own.evolve(population)
    assert own.least <= len(population[0]) < len(best_fit)
    for bins in population:
        assert sorted(i for b in bins for i in b) == list(range(n)) and max(own.fill(bins)) <= 2048


def test_crossover_keeps_every_item_once():
    own = packing.Packer(np.random.default_rng(1).integers(1, 2048, 300), 2048, 3)
    a, b, *_ = own.first()
    for child in (own.cross(a, b), own.mutate(a), own.settled(a[:50], [i for x in a[50:] for i in x])):
        assert sorted(i for x in child for i in x) == list(range(300)) and max(own.fill(child)) <= 2048


def slow_print(text):
    words = WORDS.findall(text.encode().lower())
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, radius=4):
    root = {i: i for i in prints}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: top(i) for i in prints}


def test_simhash(spark, texts, odd):
    prints = {i: slow_print(t) for i, t in texts.items()}
    got = run(spark, "op5_simhash").set_index("doc_id")
    assert got["fingerprint"].to_dict() == {i: f"{p:016x}" for i, p in prints.items()}
    assert got["component_id"].to_dict() == slow_components(prints)
    own = simhash.near_duplicates(odd).toPandas()
    assert len(own) == len(ODD)
    assert set(own.loc[own["doc_id"].isin([1, 2]), "component_id"]) == {1}
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_links_of_long_runs_lose_none(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 6)
    values = {int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 7), replace=False)) for b in base for _ in range(60)}
    values = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    want = slow_components({v & (1 << 64) - 1: v & (1 << 64) - 1 for v in values})
    for pairwise in (8, 1024):
        rows = simhash.components(simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), 4, pairwise)).collect()
        assert same_groups({r.node & (1 << 64) - 1: r.root & (1 << 64) - 1 for r in rows}, want)


@pytest.mark.parametrize("radius", [1, 3])
def test_links_of_odd_radius(spark, radius):
    rng = np.random.default_rng(radius)
    base = int(rng.integers(0, 1 << 62))
    values = sorted({base ^ sum(1 << int(k) for k in rng.choice(20, rng.integers(0, 9), replace=False)) for _ in range(150)})
    want = slow_components({v: v for v in values}, radius)
    rows = simhash.components(simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), radius, 6)).collect()
    assert same_groups({r.node: r.root for r in rows}, want)


def same_groups(root, want):
    groups, wanted = {}, {}
    for v in want:
        groups.setdefault(root.get(v, v), set()).add(v)
        wanted.setdefault(want[v], set()).add(v)
    return sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_one_row_of_each_group_stays(spark, odd):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(1, "a b c d e f", "x"), (1, long, "y"), (2, long, "z"), (3, None, "n"), (4, "", "e"), (None, "a lonely text of no id", "l"), (None, long, "c"), (5, "tail end of it all", "t"), (5, "tail end of it all", "u"), (6, "TAIL end of it all", "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, own string").withColumn("kept_id", F.lit(1)).withColumn("fp", F.lit("f"))
    got = simhash.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == sorted([(1, "a b c d e f"), (1, long), (3, ""), (0, "a lonely text of no id"), (5, "tail end of it all")])
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0
    assert simhash.drop_near_duplicates(odd).count() == simhash.near_duplicates(odd).select("component_id").distinct().count()


def test_masks_cover_every_difference():
    masks = [m & (1 << 64) - 1 for m in simhash.covering_masks(4)]
    rng = np.random.default_rng(5)
    for _ in range(3000):
        difference = sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 5), replace=False))
        assert any(not m & difference for m in masks)


@pytest.mark.parametrize(("name", "column", "modulus", "remainder"), [("op1_toxicity", "toxic", 4, 2), ("op6_quality", "quality", 5, 0)])
def test_classifiers_on_held_out_rows(spark, name, column, modulus, remainder):
    got = queries.queries()[name](spark, "/root/testdata/sf0.01").toPandas()
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.3)).all()
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % modulus == remainder)).all()
    own = got[got["held_out"]].merge(pd.read_parquet("/root/testdata/sf0.01/labels.parquet"), on="doc_id")
    positive, negative = own[own[column] == 1]["score"], own[own[column] == 0]["score"]
    assert np.mean([[p > n for n in negative] for p in positive]) > 0.8
    assert (own["predicted"] == own[column]).mean() > 0.9


def test_classifiers_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(2, 1, 0), (3, None, 1), (3, 0, 1), (99, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for made in (toxicity.toxicity, subwords.quality):
        assert made(odd, labels, id_remainder(4) >= 0).toPandas()["score"].between(0, 1).sum() == len(ODD)
        assert made(odd, labels.limit(0), id_remainder(4) >= 0).count() == len(ODD)
        assert made(odd.limit(0), labels, id_remainder(4) >= 0).count() == 0


def test_factors_learn_an_interaction():
    rows, label = [], []
    for k in range(400):
        a, b = k & 1, k >> 1 & 1
        rows.append(np.array([x for x, on in ((10, a), (20, b), (30 + k % 5, 1)) if on]))
        label.append(a & b)
    machine = toxicity.train_machine(rows, np.array(label))
    place = {t: k for k, t in enumerate(machine.terms.tolist())}

    def on(*own):  # the explicit sum over pairs
        k = [place[t] for t in own if t in place]
        return machine.bias + sum(machine.weights[i] for i in k) + sum(float(machine.factors[i] @ machine.factors[j]) for i in k for j in k if i < j)

    assert on(10, 20) > 0 > max(on(10), on(20))


def test_machine_scores_are_the_sum_over_all_pairs():
    rng = np.random.default_rng(2)
    text = "Some words, some Terms and beginnings of terms"
    own = sorted(toxicity.terms(text))
    machine = toxicity.FactorizationMachine(np.array(own), 0.3, rng.normal(0, 0.2, len(own)), rng.normal(0, 0.2, (len(own), 4)))
    z = 0.3 + machine.weights.sum() + sum(machine.factors[i] @ machine.factors[j] for i in range(len(own)) for j in range(i))
    assert machine.score(text) == pytest.approx(1 / (1 + np.exp(-z)))


def test_quality_is_the_mean_of_all_subword_vectors():
    rng = np.random.default_rng(3)
    model = subwords.SubwordModel(rng.normal(0, 1, (subwords.BUCKETS, 4)), rng.normal(0, 1, (4, 2)), np.array([0.1, -0.2]))
    texts = ["a bc bc bc d", "", "bc", "x  y\nx"]
    for text, got in zip(texts, model.scores(texts), strict=True):
        words = text.split()
        words += [subwords.AGAIN for a, b in zip(words, words[1:], strict=False) if a == b]
        buckets = [int(b) for w in words for b in subwords.subwords([w])[0]]
        z = (model.vectors[buckets].mean(axis=0) if buckets else np.zeros(4)) @ model.output + model.bias
        assert got == pytest.approx(np.exp(z[1]) / np.exp(z).sum(), rel=1e-5)


def test_piece_digests_of_odd_rows(spark, odd):
    model = tokens.piece_model(tokens.tokenizer_path("piece_bpe_32k.model")).model
    got = tokens.piece_codec(odd, tokens.tokenizer_path("piece_bpe_32k.model")).toPandas()
    want = sorted((t or "", len(model.encode(t or "")), model.decode(model.encode(t or ""))) for _, t in ODD)
    assert sorted(zip(got["n_tokens"], got["decoded"], strict=True)) == sorted((n, d) for _, n, d in want)


def test_media_round_trip(spark, odd):
    got = {r.doc_id: r for r in media.store_media(odd).collect()}
    for doc_id, text in ODD:
        payload, rate = media.wav_payload(bytes(got[doc_id].media))
        raw = (text or "").encode()
        assert payload[: len(raw)] == raw and not payload[len(raw) :].strip(b"\0") and len(payload) % 64 == 0 < len(payload) and rate == media.RATE
    assert media.media_digest(odd).filter("doc_id = 3").select("feature", "media_sha256").distinct().count() == 1
    assert media.media_digest(odd.limit(0)).count() == 0 and media.media_digest(odd).count() == len(ODD)


def slow_log_mel(x, rate):
    """Frame by frame with a plain Fourier sum, and triangles bin by bin."""
    n = max(1, -(-max(len(x) - media.FRAME, 0) // media.HOP) + 1)
    x = np.concatenate((x, np.zeros((n - 1) * media.HOP + media.FRAME - len(x))))
    edges = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), media.MELS + 2) / 2595) - 1)
    turn = np.exp(-2j * np.pi * np.outer(np.arange(media.FRAME // 2 + 1), np.arange(media.FRAME)) / media.FRAME)
    out = []
    for k in range(n):
        power = np.abs(turn @ (x[k * media.HOP : k * media.HOP + media.FRAME] * np.hanning(media.FRAME))) ** 2
        row = []
        for lo, mid, hi in zip(edges, edges[1:], edges[2:], strict=False):
            f = np.arange(media.FRAME // 2 + 1) * rate / media.FRAME
            row.append(sum(p * max(0, min((q - lo) / (mid - lo), (hi - q) / (hi - mid))) for p, q in zip(power, f, strict=True)))
        out.append(10 * np.log10(np.maximum(row, 10 ** (media.FLOOR_DB / 10))))
    return np.array(out)


def slow_resample(x, up, down):
    """Zeros put between samples, the whole filter, and every down-th value."""
    h = media.low_pass(up, down).astype(float)
    wide = np.zeros(len(x) * up)
    wide[::up] = x
    return np.convolve(wide, h)[len(h) // 2 :][: len(x) * up][::down]


def test_stored_tensors_are_the_log_mel_frames(spark, texts):
    some = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(12)
    for r in media.stored_features(some).collect():
        payload = (texts[r.doc_id] or "").encode()
        payload += bytes(max(64, -(-len(payload) // 64) * 64) - len(payload))
        x = slow_resample((np.frombuffer(payload, np.uint8).astype(float) - 128) / 128, media.UP, media.DOWN)
        want = slow_log_mel(x, media.RATE * media.UP / media.DOWN)
        rows = media.read_tensors(bytes(r.tensors))
        assert rows.schema.field("tensor").type == pa.fixed_shape_tensor(pa.float16(), [media.CLIP, media.MELS])
        got = rows.column("tensor").to_numpy_ndarray().reshape(-1, media.MELS).astype(float)
        assert np.abs(got[: len(want)] - want).max() < 0.1 and (got[len(want) :] == media.FLOOR_DB).all()
        step = media.HOP * media.DOWN / media.UP / media.RATE
        assert rows.column("end_s")[-1].as_py() == pytest.approx(len(want) * step) and rows.column("begin_s")[0].as_py() == 0
        assert (r.payload_bytes, r.tail_crc32) == (len(payload), zlib.crc32(payload[-64:]))


@pytest.mark.parametrize(("up", "down"), [(1, 2), (2, 1), (3, 2), (5, 7)])
def test_resampled_tone(up, down):
    tone = lambda n, rate: np.sin(2 * np.pi * 440 * np.arange(n) / rate)
    got = media.resample(tone(16_000, 16_000).astype(np.float32), up, down)
    assert np.abs(got - tone(len(got), 16_000 * up / down))[200:-200].max() < 1e-3


def test_hysteresis():
    assert media.hysteresis_spans(np.array([0, 10, 3, 3, -8, 3, -8, 9.0]), 5, -5) == [(1, 4), (7, 8)]


def test_rule_statistics(spark, odd):
    for _, text in [*ODD, (0, "a b c d e a b c d e x\na b\na b\n#*$ |")]:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
        hit = {j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))
        assert rules.statistics(text)[:5] == want
    labels = spark.createDataFrame([(3, 1)], "doc_id long, quality int")
    got = rules.forest_verdicts(odd, labels)
    assert got.count() == len(ODD) and got.filter("kept AND base_failed").count() == 0
    assert rules.forest_verdicts(odd.limit(0), labels).count() == 0


def test_forest_isolates_what_is_far():
    rng = np.random.default_rng(0)
    pool = rng.normal(0, 1, (2000, 3))
    score = rules.grow(pool).score(np.vstack([pool, [[9, 9, 9]]]))
    assert score[-1] > np.quantile(score[:-1], 0.999)


def test_forest_threshold_uses_both_labels(spark):
    assert rules.best_threshold([(400, 90, 1), (450, 8, 2), (500, 1, 40), (700, 1, 7)]) == (0.45, 5)
    assert rules.best_threshold([(400, 9, 0)]) == rules.best_threshold([(400, 0, 9)]) == (rules.UNLABELLED, 0)
    got = run(spark, "op9_quality_rules").merge(pd.read_parquet(f"{SF}/labels.parquet"), on="doc_id")
    own = got[~got["base_failed"]]
    assert (~own[own["quality"] == 0]["kept"]).mean() > 0.5 and own[own["quality"] == 1]["kept"].mean() > 0.95


def test_labels_choose_the_ratios():
    rng = np.random.default_rng(6)
    pool = rng.normal(0, 1, (3000, 4))
    labelled, quality = rng.normal(0, 1, (300, 4)), np.repeat([1, 0], [270, 30])
    labelled[quality == 0, 2] += 8
    assert rules.chosen(pool, labelled, quality)[0] == 2 and len(rules.chosen(pool, labelled, quality * 0)) == 4


def test_path_lengths():
    """Scores against trees walked one node at a time, and paths of single points against the expectation."""
    rng = np.random.default_rng(7)
    pool = rng.normal(0, 1, (500, 2))
    forest = rules.grow(pool, 30, 64)

    def walked(x, t):
        node = 0
        while forest.feature[t, node] >= 0:
            node = int(forest.left[t, node]) + int(x[forest.feature[t, node]] >= forest.split[t, node])
        return forest.length[t, node]

    got = forest.score(pool[:20])
    for x, score in zip(pool[:20], got, strict=True):
        assert score == pytest.approx(2 ** (-np.mean([walked(x, t) for t in range(30)]) / float(rules.mean_path(64))))
    assert float(rules.mean_path(3)) == pytest.approx(2 * (np.log(2) + 0.5772156649) - 4 / 3)


def test_verdicts_follow_scores(spark):
    got = run(spark, "op9_quality_rules")
    stats = pd.DataFrame([rules.statistics(t)[:5] for t in pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id")["text"].reindex(got["doc_id"])], columns=rules.BASE)
    assert (stats.to_numpy() == got[rules.BASE].to_numpy()).all()
    failed = (stats["n_words"] < 10) | (100 * stats["n_repeat_words"] > 20 * stats["n_words"])
    assert (failed.to_numpy() == got["base_failed"]).all()
    kept, gone = got[got["kept"]], got[~got["kept"] & ~got["base_failed"]]
    assert not kept["base_failed"].any() and (not len(gone) or kept["score"].max() <= gone["score"].min())


def test_language_model(spark, texts, odd):
    got = run(spark, "op10_lm_scoring").set_index("doc_id")
    words = {i: [*WORDS.findall(t.encode().lower()), None] for i, t in texts.items()}
    train = [i for i in texts if zlib.crc32(str(i).encode()) % 10]
    count = Counter(w for i in train for w in words[i])
    n, v = sum(count.values()), len(count)
    for i, own in words.items():
        assert got["base_score"][i] == pytest.approx(sum(np.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own))
        assert (got["n_tokens"][i], got["n_known"][i], got["train_tokens"][i]) == (len(own), sum(count[w] > 0 for w in own), n)
    held = got[got["held_out"]]
    assert held["score"].sum() > held["base_score"].sum() and (got["score"] < 0).all()
    assert pitman_yor.score_texts(odd, id_remainder(10) != 0).count() == len(ODD)
    assert pitman_yor.score_texts(odd, id_remainder(10) < 0).filter("score <= 0").count() == len(ODD)  # one unseen word has all
    assert pitman_yor.score_texts(odd.limit(0), id_remainder(10) != 0).count() == 0


def test_contexts_are_whole_words(spark):
    """Unseen words before a seen one all give it the same probability, whichever hashes resemble a seen word's."""
    top = lambda w: xxhash.xxh64_intdigest(w, 7) >> 48
    like = next(w for w in (f"u{k}" for k in range(10**7)) if top(w) == top("alpha"))
    rows = [(k, "alpha beta" if k % 2 else "gamma delta") for k in range(400)] + [(1000, f"{like} beta"), (1001, "other beta")]
    got = pitman_yor.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 1000).toPandas().set_index("doc_id")
    assert got.score[1000] == pytest.approx(got.score[1001], abs=1e-5)
    assert got.score[1] > got.score[1001] + 1


def test_licenses(spark, odd):
    got = licenses.license_scan(odd).collect()
    assert [(r.doc_id, r.license, r.wording) for r in got] == [(6, "CC-BY-NC-4.0 notice", "")]
    changed = licenses.TEMPLATES["MIT"].replace("free of charge", "for free")
    found = licenses.scan_block("Copyright 2020 X. " + changed)
    assert found[0][0] == "MIT" and "-charge" in found[0][5] and found[0][3] > 0
    assert not licenses.scan_block("The permission slip was signed by a parent.")


WRAPPED = {
    "MIT": """
        Permission is hereby granted, free of charge, to any person obtaining a copy
        of this software and associated documentation files (the "Software"), to deal
        in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is
        furnished to do so, subject to the following conditions:

        The above copyright notice and this permission notice shall be included in all
        copies or substantial portions of the Software.

        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR""",
    "BSD-2-Clause": """
        Redistribution and use in source and binary forms, with or without
        modification, are permitted provided that the following conditions are met:

        1. Redistributions of source code must retain the above copyright notice, this
           list of conditions and the following disclaimer.

        2. Redistributions in binary form must reproduce the above copyright notice,
           this list of conditions and the following disclaimer in the documentation
           and/or other materials provided with the distribution.""",
    "Apache-2.0": """
        # Licensed under the Apache License, Version 2.0 (the "License");
        # you may not use this file except in compliance with the License.
        # You may obtain a copy of the License at
        #
        #     http://www.apache.org/licenses/LICENSE-2.0
        #
        # Unless required by applicable law or agreed to in writing, software
        # distributed under the License is distributed on an "AS IS" BASIS,
        # WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "GPL-3.0": """
        This program is free software: you can redistribute it and/or modify
        it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version 3 of the License, or
        (at your option) any later version.""",
}


@pytest.mark.parametrize("name", WRAPPED)
def test_wrapped_licenses(name):
    text = f"Notes on the build\n\nCopyright (c) 2020 X. Y.\n{WRAPPED[name]}\n\nAn end of another kind."
    (block,) = licenses.candidate_blocks(text)
    assert text[block.start : block.stop] == block.text
    assert name in {r[0] for r in licenses.scan_block(block.text)}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Licensed under CC BY 3.0.", {"CC-BY-3.0 notice"}),
        ("Licensed under CC BY-SA 3.0.", {"CC-BY-SA-3.0 notice"}),
        ("Licensed under CC BY 3.7.", set()),
        ("This text has a Creative Commons Attribution-NonCommercial 2.5 license.", {"CC-BY-NC-2.5"}),
        ("This work is licensed under the GNU General Public License, version 2.", {"GPL-2.0 notice"}),
        ("This work is licensed under the GNU Lesser General Public License, version 2.1.", {"LGPL-2.1 notice"}),
        (licenses.TEMPLATES["BSD-3-Clause"], {"BSD-3-Clause"}),
        (licenses.TEMPLATES["BSD-2-Clause"], {"BSD-2-Clause"}),
        (licenses.TEMPLATES["MPL-2.0"].replace("You can", "you may"), {"MPL-2.0"}),
        (licenses.TEMPLATES["AGPL-3.0"].replace("modify it", "change it"), {"AGPL-3.0"}),
        (licenses.TEMPLATES["GPL-2.0"], {"GPL-2.0"}),
        (licenses.TEMPLATES["GPL-3.0"].replace("version 3", "version 4"), set()),
        (licenses.TEMPLATES["Unlicense"], {"Unlicense"}),
        ("Her license to sell public domain maps had the permission of nobody.", set()),
    ],
)
def test_which_license(text, want):
    assert {r[0] for r in licenses.scan_block(text)} == want


def test_planted_licenses(spark):
    """Licenses between other sentences: each is found, by its own name, and nothing elsewhere."""
    names = sorted(licenses.TEMPLATES)
    filler = "The warranty of the old mill had gone with the permission to grind."
    rows = [(k, f"{filler} Some words stand here.\n\n{licenses.TEMPLATES[n]}\n\nAnd here others end it. {filler}") for k, n in enumerate(names)] + [(1000 + k, f"{filler} " * k) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {}
    for r in licenses.license_scan(docs).collect():
        found.setdefault(r.doc_id, set()).add(r.license)
    assert found == {k: {n} for k, n in enumerate(names)}
    assert licenses.license_scan(docs.limit(0)).count() == 0


def test_licenses_of_whole_documents(spark, texts):
    """The query's rows for notices against a search for their words."""
    got = {(r.doc_id, r.license) for r in run(spark, "op2_license_scan").itertuples() if not r.wording}
    want = set()
    for doc_id, text in texts.items():
        words = " " + " ".join(licenses.words_of(text)) + " "
        want |= {(doc_id, n) for n, t in licenses.TEMPLATES.items() if f" {' '.join(licenses.words_of(t))} " in words}
    assert got == want


def test_licenses_beside_exact_ones():
    changed = licenses.TEMPLATES["MIT"].replace("free of charge", "for free")
    found = {r[0]: r[5] for r in licenses.scan_block(changed + " Licensed under CC BY 4.0.")}
    assert set(found) == {"MIT", "CC-BY-4.0 notice"} and found["CC-BY-4.0 notice"] == "" and "-charge" in found["MIT"]


def test_dictionaries_find_licenses(monkeypatch):
    """A template is looked for only where its own dictionary makes words smaller."""
    own = dict(licenses._compressors())
    assert licenses.winners(licenses.words_of(licenses.TEMPLATES["MIT"]))["MIT"]
    assert "MIT" in {r[0] for r in licenses._scan(licenses.TEMPLATES["MIT"])}
    other = zstandard.ZstdCompressor(level=licenses.FIND, dict_data=zstandard.ZstdCompressionDict(b"0123456789" * 9, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_dict_id=False, **licenses._PLAIN)
    monkeypatch.setattr(licenses, "_compressors", lambda: own | {"MIT": (*own["MIT"][:2], other)})
    assert "MIT" not in {r[0] for r in licenses._scan(licenses.TEMPLATES["MIT"])}


def test_dictionaries_miss_no_notice_among_others():
    rng, names = np.random.default_rng(1), sorted(n for n, t in licenses.TEMPLATES.items() if len(licenses.words_of(t)) < licenses.SHORT and n.endswith("notice"))
    for _ in range(20):
        some = rng.choice(names, 12).tolist()
        assert {r[0] for r in licenses._scan(" ".join(licenses.TEMPLATES[n] for n in some))} == set(some)


def test_short_notice_in_a_long_block():
    words = np.random.default_rng(0).permutation([f"w{k}x{k * k}" for k in range(600)])
    around = [f"The warranty of {' '.join(words[k : k + 6])} has gone." for k in range(0, 600, 6)]
    text = " ".join([*around[:50], "Distributed under the BSD License.", *around[50:]])
    assert [r[0] for r in licenses.scan_block(text)] == ["BSD notice"]


@pytest.mark.parametrize("stage", range(4))
def test_stages_on_odd_rows_and_empty_tables(spark, odd, stage):
    """Stages but the last return their input's columns and lose no row that they don't reject."""
    import corpus_pipeline

    _, run_stage = corpus_pipeline.STAGES[stage]
    docs = odd.withColumn("kept_id", F.lit(1)).withColumn("own", F.lit(2)).withColumn("piece", F.lit(3))
    for rows in (docs, docs.limit(0)):
        got = run_stage(spark, rows, SF)
        n = got.count()
        if stage < 3:
            assert got.columns == docs.columns and n <= rows.count()
        else:
            assert got.filter("piece = 0").count() == rows.count()


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    toxic = corpus_pipeline.toxicity_stage(spark, docs, "/root/testdata/sf0.01")
    assert toxic.schema == docs.schema and 0 < toxic.count() < docs.count()
    single = corpus_pipeline.near_duplicate_stage(spark, docs, SF)
    assert sorted(single.columns) == sorted(docs.columns)
    assert single.count() == run_components(spark)
    assert [n for n, _ in corpus_pipeline.STAGES] and corpus_pipeline.run(spark, SF).count() > 0


def run_components(spark):
    return queries.op5_simhash(spark, "/root/testdata/sf0.01").select("component_id").distinct().count()
