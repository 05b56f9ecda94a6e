import gc
from collections import defaultdict

import pandas as pd
import pyarrow as pa

from tokenloom.llm import ngram_lm, pieces


def kept_dicts(work):
    """How many dicts of words are still there after the work, without the help of the collector."""
    gc.collect()
    gc.disable()
    try:
        work()
        return sum(type(one) is defaultdict and len(one) > 500 for one in gc.get_objects())
    finally:
        gc.enable()


def test_words_of_a_batch_are_let_go():
    text = " ".join(f"word{at}" for at in range(1000))
    frame = pd.DataFrame({"key": ["1", "2"], "text": [text, ""]})
    assert kept_dicts(lambda: [len(batch[0]) for batch in ngram_lm._batches(iter([frame, frame]))]) == 0


def test_units_of_a_batch_are_let_go():
    with open(pieces.default_model(), "rb") as file:
        vocabulary = pieces.Vocabulary(file.read())
    texts = [" ".join(f"word{at}" for at in range(1000)), ""]
    assert kept_dicts(lambda: pieces._batch(vocabulary, pa.array([1, 2], pa.int64()), texts, 2, 0)) == 0
