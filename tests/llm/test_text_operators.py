import collections
import itertools
import math
import random
import zlib

import pyarrow as pa
import pytest

from tokenloom.llm import chat, common, decontaminate, ngram_lm, pieces, quality, toxicity

DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, n_hit string, key string"


def documents(spark, rows):
    return spark.createDataFrame([(at, text, "en", "s", 0, "x", "y", "z") for at, text in rows], DOCUMENT)


# --- decontamination


def brute_contamination(texts, items, window=13):
    import re

    def words(text):
        lowered = "".join(chr(ord(char) + 32) if "A" <= char <= "Z" else char for char in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)

    found = {}
    for at, text in texts:
        mine, hit, met = words(text), set(), set()
        for item, other in items:
            theirs = words(other)
            size = min(window, len(theirs))
            for start in range(max(0, len(theirs) - window) + 1 if theirs else 0):
                for place in range(len(mine) - size + 1):
                    if mine[place : place + size] == theirs[start : start + size]:
                        hit.update(range(place, place + size))
                        met.add(item)
        found[at] = (len(mine), len(hit), len(met), bool(hit) and 20 * len(hit) >= len(mine))
    return found


def test_contamination_against_brute_force(spark):
    chance = random.Random(4)
    vocabulary = ["the", "of", "a"] * 4 + [f"w{at}" for at in range(40)] + ["été", "Ünï"]
    items = [(at, " ".join(chance.choices(vocabulary, k=chance.choice((1, 2, 12, 13, 14, 30))))) for at in range(15)]
    items += [(20, None), (21, ""), (22, "..."), (3, items[3][1])]
    rows = []
    for at in range(60):
        text = chance.choices(vocabulary, k=chance.choice((0, 1, 20, 90)))
        for _ in range(chance.randint(0, 2)):
            passage = chance.choice(items)[1] or ""
            text.insert(chance.randint(0, len(text)), passage.upper() if chance.random() < 0.3 else passage)
        rows.append((at, chance.choice((" ", ", ", "\n")).join(text)))
    rows += [(60, None), (61, ""), (62, rows[0][1])]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    frame = documents(spark, rows + [rows[5]])
    found = decontaminate.contamination(frame, benchmark).collect()
    assert len(found) == len(rows) + 1
    brute = brute_contamination(rows, items)
    assert {row.doc_id: (row.n_words, row.n_hit, row.n_items, row.contaminated) for row in found} == brute
    assert any(value[3] for value in brute.values())


def test_proximity(spark):
    frame = documents(spark, [(1, "red x x blue x green"), (2, "red " + "x " * 30 + "blue green"), (3, "blue red green")])
    items = spark.createDataFrame([(7, "Red green, blue")], "item_id bigint, text string")
    words = common.stored(decontaminate.item_words(items), "near")
    index = decontaminate.build_index(frame.select("doc_id", "text"), words)
    keys = {row.key: row.doc_id for row in frame.select("doc_id", decontaminate.document_key().alias("key")).collect()}
    found = decontaminate.proximity_matches(index, words, width=6).collect()
    assert sorted((keys[row.key], row.first) for row in found) == [(1, 0), (3, 0)]


def test_contamination_of_empty_tables(spark):
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contamination(documents(spark, []), items).count() == 0
    row = decontaminate.contamination(documents(spark, [(1, "a b")]), items).first()
    assert (row.n_words, row.n_hit, row.contaminated) == (2, 0, False)


# --- language model


@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_model_against_brute_force(spark, monkeypatch, order):
    monkeypatch.setattr(ngram_lm, "_BATCH_TOKENS", 300)
    chance = random.Random(2)
    words = ["the"] * 30 + [f"w{at}" for at in range(60)] + ["Été"]
    rows = [(at, " ".join(chance.choices(words, k=chance.choice((0, 1, 10, 60))))) for at in range(150)]
    rows += [(400, None), (401, "unseen words only"), (402, "THE\tthe"), (403, rows[3][1]), (403, "w1 " * 2000)]
    found = ngram_lm.held_out_scores(documents(spark, rows), order=order).collect()
    assert len(found) == len(rows)

    def tokens(text):
        return [*(text or "").encode().lower().split(), "end"]

    def grams(text, size):
        padded = ["start"] * (size - 1) + text
        return [tuple(padded[at : at + size]) for at in range(len(text))]

    held = {at: zlib.crc32(str(at).encode()) % 5 == 1 for at, _ in rows}
    train = [tokens(text) for at, text in rows if not held[at]]
    single = collections.Counter(itertools.chain(*train))
    total, size = sum(single.values()), len(single)
    counts = {order: collections.Counter(gram for text in train for gram in grams(text, order))}
    for at in range(order - 1, 0, -1):
        counts[at] = collections.Counter(gram[1:] for gram in counts[at + 1])
    cut, contexts = {}, {}
    for at, table in counts.items():
        cut[at] = [0, *ngram_lm.discounts([sum(value == n for value in table.values()) for n in (1, 2, 3, 4)])]
        contexts[at] = collections.defaultdict(lambda: [0, 0, 0, 0])
        for gram, count in table.items():
            contexts[at][gram[:-1]][0] += count
            contexts[at][gram[:-1]][min(count, 3)] += 1

    def chance_of(gram):
        at = len(gram)
        lower = chance_of(gram[1:]) if at > 1 else 1 / (size + 1)
        if gram[:-1] not in contexts[at]:
            return lower
        every, *n = contexts[at][gram[:-1]]
        count = counts[at].get(gram, 0)
        kept = sum(cut[at][k + 1] * n[k] for k in range(3)) / every
        return (count - cut[at][min(count, 3)] if count else 0) / every + kept * lower

    for context in [("start",) * (order - 1), (b"the",) * (order - 1), (b"w1",) * (order - 1)]:
        assert sum(chance_of((*context, word)) for word in [*single, "unknown"]) == pytest.approx(1)
    texts = collections.defaultdict(list)
    for at, text in rows:
        mine = tokens(text)
        score = sum(math.log10(chance_of(gram)) for gram in grams(mine, order))
        base = sum(math.log10((single.get(word, 0) + 0.5) / (total + 0.5 * (size + 1))) for word in mine)
        texts[at].append((len(mine), sum(word in single for word in mine), base, score))
    for row in found:
        assert (row.held_out, row.train_tokens) == (held[row.doc_id], total)
        mine = (row.n_tokens, row.n_known, row.base_score, row.score)
        assert any(mine == pytest.approx(other, rel=1e-5) for other in texts[row.doc_id])


def test_language_model_without_training(spark):
    assert ngram_lm.train(documents(spark, []).select("text")) is None
    row = ngram_lm.score(documents(spark, [(1, "a b")]), None).first()
    assert (row.n_tokens, row.n_known, row.score) == (3, 0, 0.0)


# --- classifiers


@pytest.mark.parametrize("module, train, label", [(quality, quality.train_quality, "quality"), (toxicity, toxicity.train_toxicity, "toxic")])
def test_classifiers_on_held_out_rows(spark, module, train, label):
    chance = random.Random(6)
    words = [f"w{at}" for at in range(80)]
    rows, labels = [], []
    for at in range(500):
        bad = at % 3 == 0
        text = chance.choices(words, k=40)
        if bad:
            text[3:8] = ["vile!!"] * 5
        rows.append((at, " ".join(text)))
        labels.append((at, int(bad != (label == "quality")), int(bad)))
    labels += [(0, labels[0][1], labels[0][2]), (None, 1, 1), (77, None, None), (9999, 1, 0)]
    frame = documents(spark, [*rows, (600, None), (601, ""), (601, "")])
    marked = spark.createDataFrame(labels, f"doc_id bigint, {label} int, lang int")
    weights = train(frame, marked)
    scored = module.score_quality(frame, weights) if module is quality else module.score_toxicity(frame, weights)
    found = [row.asDict() for row in scored.select("doc_id", "held_out", "score", "predicted").collect()]
    assert len(found) == 503 and all(0 <= row["score"] <= 1 for row in found)
    truth = {at: value for at, value, *_ in labels}
    held = [row for row in found if row["held_out"] and row["doc_id"] < 500 and truth[row["doc_id"]] is not None]
    assert len(held) > 50 and all(row["predicted"] == truth[row["doc_id"]] for row in held)
    assert all(row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % module.MODULUS == module.HELD_OUT) for row in found)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_without_labels(spark, module):
    frame = documents(spark, [(1, "a text"), (2, None)])
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    train = module.train_quality if module is quality else module.train_toxicity
    score = module.score_quality if module is quality else module.score_toxicity
    assert {row.score for row in score(frame, train(frame, none)).collect()} == {0.5}
    ones = spark.createDataFrame([(1, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert all(row.score > 0.5 for row in score(frame, train(frame, ones)).collect())


# --- conversations


def test_chat_round_trip(spark):
    texts = [None, "", "\\", "\\\\</turn>", "### user:\n</turn>\n", "####", "<\\/turn>", "a\nb", "# #\\#", ":", "é😀"]
    rows = [(1, at, "assistant" if at % 2 else "user", text) for at, text in enumerate(texts)]
    rows += [(2, 0, "user", "only"), (3, 1, "assistant", "x"), (3, 1, "assistant", "x"), (3, None, None, "first"), (None, 0, "we:ird\\", "q")]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    examples = chat.format_turns(frame)
    replies = examples.where("loss_length > 0").select("conv_id", chat.loss_text().alias("reply")).collect()
    assert sorted(row.reply for row in replies if row.conv_id == 1) == sorted(t for t in texts[1::2] if t)
    last = examples.where("last").select("conv_id", chat.parse_turns("text").alias("turns")).collect()
    turns = {row.conv_id: [tuple(turn) for turn in row.turns] for row in last}
    assert turns[1] == [(role, text or "") for _, _, role, text in rows[: len(texts)]]
    assert turns[2] == [("user", "only")] and turns[None] == [("we:ird\\", "q")]
    assert turns[3] == [("", "first"), ("assistant", "x"), ("assistant", "x")]
    assert examples.where("conv_id = 3").count() == 2
    assert chat.format_turns(frame.limit(0)).count() == 0


# --- pieces


def test_samples_follow_their_distribution():
    with open(pieces.default_model(), "rb") as file:
        vocabulary = pieces.Vocabulary(file.read())
    lattice = pieces.Lattice(vocabulary, vocabulary.split("the in"))

    def segmentations(unit):
        def grow(at, ids, chance):
            if at == lattice.unit_ends[unit]:
                yield tuple(ids), chance
                return
            for arc in range(lattice.first[at], lattice.first[at + 1]):
                yield from grow(lattice.end[arc], [*ids, int(lattice.ids[arc])], chance * lattice.prob[arc])

        return list(grow(lattice.starts[unit], [], 1.0))

    every = {a + b: p * q for (a, p), (b, q) in itertools.product(segmentations(0), segmentations(1))}
    assert sum(every.values()) == pytest.approx(1.0)
    count = 6000
    rows = pieces._batch(vocabulary, pa.array(range(count)), ["the in"] * count, 3, 0).to_pylist()
    first = collections.Counter(tuple(row["samples"][0]["ids"]) for row in rows)
    second = collections.Counter(tuple(row["samples"][1]["ids"]) for row in rows)
    for ids, chance in every.items():
        after = sum(q * chance / (1 - q) for other, q in every.items() if other != ids)
        for seen, wanted in ((first[ids], chance), (second[ids], after)):
            assert abs(seen - count * wanted) < 5 * math.sqrt(count * wanted * (1 - wanted) + 1)
    for row in rows[:200]:
        assert len({tuple(sample["ids"]) for sample in row["samples"]}) == 3
        assert all(sample["log_prob"] == pytest.approx(math.log(every[tuple(sample["ids"])])) for sample in row["samples"])
        values = [sample["value"] for sample in row["samples"]]
        assert values == sorted(values, reverse=True)
    weighed = sum(math.exp(s["log_prob"]) / s["inclusion"] for row in rows for s in row["samples"]) / count
    assert weighed == pytest.approx(1.0, abs=0.02)


def test_encoding_and_decoding(spark):
    texts = ["", None, " ", "\n", "\n\nab  c\n x ", "日本ﬁ😀\t", "x" * 3000, "Hello, World!", "▁odd"]
    rows = list(enumerate(texts)) + [(None, "Hello, World!"), (7, "Hello, World!")]
    found = pieces.decode(pieces.encode_and_sample(documents(spark, rows), k=3)).collect()
    with open(pieces.default_model(), "rb") as file:
        vocabulary = pieces.Vocabulary(file.read())
    for row in found:
        text = "Hello, World!" if row.doc_id is None else texts[row.doc_id] or ""
        assert row.n_chars == len(text) and row.ids == vocabulary.processor.encode(text)
        assert row.round_trip == (row.decoded == text) == ("▁" not in text)
        assert all(vocabulary.processor.decode(sample.ids) == text.replace("▁", " ") for sample in row.samples)
    same = [row.samples for row in found if row.doc_id == 7]
    assert same[0] == same[1]
    assert pieces.encode_and_sample(documents(spark, [])).count() == 0
