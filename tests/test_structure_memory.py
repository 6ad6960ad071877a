"""What a task holds of the files it reads."""

import gc
import weakref

import pandas as pd

from textloom.operators import structure as s


def test_a_batch_of_files_is_let_go_before_the_next_one_comes():
    frames, alive = [], []

    def batches():
        for k in range(3):
            gc.collect()
            alive.append(sum(r() is not None for r in frames))
            frame = pd.DataFrame({"rel": [f"{k}.py"], "lang": ["py"], "content": [f"def f{k}(a):\n    return a\n"]})
            frames.append(weakref.ref(frame))
            yield frame
            del frame

    class Rows:
        def select(self, *columns):
            return self

        def mapInPandas(self, run, schema):  # noqa: N802
            return pd.concat(list(run(batches())))

    got = s.extract_definitions(Rows(), "function")
    assert got["name"].tolist() == ["f0", "f1", "f2"] and got["rel"].tolist() == ["0.py", "1.py", "2.py"]
    assert alive == [0, 0, 0]
