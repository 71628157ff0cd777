"""What Python workers keep from task to task."""

import sys

import pyarrow as pa
import pytest

from gridvalue.llm import common, language, simhash
from gridvalue.llm.token_files import worker_state


class _Model:
    def predict(self, texts):
        return ["en"] * len(texts), [1.0] * len(texts), [False] * len(texts)


@pytest.mark.parametrize("module, start", [
    (simhash, lambda: simhash.add_fingerprint(None)), (language, lambda: language.add_language(None, _Model()))])
def test_tasks_keep_no_cache_of_another_operator(monkeypatch, module, start):
    steps = []
    monkeypatch.setattr(module, "add_by_slice", lambda docs, text, run, fields, **more: steps.append(run))
    start()
    assert worker_state("large", lambda: "words") == "words"
    out = steps[0](pa.RecordBatch.from_pydict({"text": ["a b c", None]}))
    assert all(len(column) == 2 for column in out.values())
    assert common.WORKER_STATE not in sys.modules
    assert worker_state("large", lambda: "anew") == "anew"
    common.drop_worker_state()
