import collections
import json
import pickle
import zipfile

import numpy as np
import pytest

from driftlens.sources import archives
from driftlens.sources.datasource import read_run
from driftlens.sources.layouts import COUNTS, DELIMITER, EMPTY, IDS, MAP_PREFIX, SLOTS, WEIGHT_PREFIX, has_id_map, state_tensors


class Tensor:
    """Pickles as the format does: a rebuild call on a stored storage."""

    def __init__(self, key, value):
        self.key, self.value = key, value


class Writer(pickle._Pickler):
    kinds = {"<f4": "FloatStorage", "<i8": "LongStorage"}

    def save_named(self, module, name):
        self.write(pickle.GLOBAL + f"{module}\n{name}\n".encode())

    def save(self, obj, *a, **k):
        if not isinstance(obj, Tensor):
            return super().save(obj, *a, **k)
        v = obj.value
        self.save_named("torch._utils", "_rebuild_tensor_v2")
        self.write(pickle.MARK)
        self.write(pickle.MARK)
        super().save("storage")
        self.save_named("torch", self.kinds[v.dtype.str])
        for x in (obj.key, "cpu", v.size):
            super().save(x)
        self.write(pickle.TUPLE + pickle.BINPERSID)
        for x in (0, v.shape, tuple(s // v.itemsize for s in v.strides), False, None):
            super().save(x)
        self.write(pickle.TUPLE + pickle.REDUCE)


def write_state(path, state):
    path.parent.mkdir(parents=True, exist_ok=True)
    body = collections.OrderedDict((k, Tensor(str(i), v)) for i, (k, v) in enumerate(state.items()))
    import io

    out = io.BytesIO()
    Writer(out, 2).dump(dict(body))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("archive/data.pkl", out.getvalue())
        for i, v in enumerate(state.values()):
            z.writestr(f"archive/data/{i}", v.tobytes("A"))


def state(ids, slots, counts, weight):
    pad = len(weight) - len(ids)
    p = MAP_PREFIX + "t."
    return {
        p + IDS: np.array([*ids, *[EMPTY] * pad], "<i8"), p + SLOTS: np.array([*slots, *[0] * pad], "<i8"), p + COUNTS: np.array([*counts, *[0] * pad], "<i8"),
        p + DELIMITER: np.array([EMPTY], "<i8"), WEIGHT_PREFIX + "t.weight": weight, "tower.weight": np.ones((2, 3), "<f4"), MAP_PREFIX + "lost." + IDS: np.array([1], "<i8"),
    }


def test_run_of_state_dicts(spark, tmp_path):
    weight = np.arange(20, dtype="<f4").reshape(5, 4)
    write_state(tmp_path / "ckpt_001/state_dict.pt", state([10, 20, 30], [4, 2, 0], [7, 3, 1], weight + 1))
    write_state(tmp_path / "ckpt_000/checkpoint.pt", state([10, 20], [4, 2], [6, 2], weight))
    (tmp_path / "ckpt_001/meta.json").write_text(json.dumps({"global_step": 42}))
    rows = {(r.tbl, r.ckpt, r.id): r for r in read_run(spark, str(tmp_path)).collect()}
    assert len(rows) == 5 + 4
    assert rows["t", 1, 10].vec == (weight[4] + 1).tolist() and rows["t", 1, 10].cnt == 7 and rows["t", 1, 10].step == 42
    assert rows["t", 0, 20].slot == 2 and rows["t", 0, 20].step is None
    assert rows["dense:tower.weight", 0, 1].vec == [1, 1, 1] and rows["dense:tower.weight", 0, 1].cnt is None


def test_other_content_is_refused(tmp_path):
    (tmp_path / "none.pt").write_bytes(b"no zip")
    assert not has_id_map(str(tmp_path / "none.pt"))
    write_state(tmp_path / "x.pt", {"other": np.ones(3, "<f4")})
    assert not has_id_map(str(tmp_path / "x.pt"))
    with zipfile.ZipFile(tmp_path / "bad.pt", "w") as z:
        z.writestr("archive/data.pkl", pickle.dumps(json.loads))
    with pytest.raises(pickle.UnpicklingError, match="not allowed"):
        state_tensors(str(tmp_path / "bad.pt"))


class Counted:
    """A file that notes which bytes are read."""

    def __init__(self, raw):
        self.raw, self.read = raw, []

    def size(self):
        return len(self.raw)

    def read_at(self, n, at):
        self.read.append((at, n))
        return self.raw[at : at + n]


def test_rows_read_their_own_bytes_only(tmp_path):
    values = {"a": np.arange(60_000, dtype="<f4").reshape(-1, 6), "turned": np.arange(24, dtype="<i8").reshape(4, 6).T, "one": np.array(7, "<i8"), "none": np.zeros((0, 3), "<f4")}
    write_state(tmp_path / "x.pt", values)
    raw = (tmp_path / "x.pt").read_bytes()
    for at in (0, 1234):  # as a file of its own, and within another
        file = Counted(b"?" * at + raw)
        archive = archives.Archive(file, at, len(raw))
        tensors = archive.load()
        del file.read[:]
        assert (archive.rows(tensors["a"], 5_000, 5_010) == values["a"][5_000:5_010]).all()
        assert sum(n for _, n in file.read) == 10 * 24 + 30
        assert (archive.rows(tensors["a"], 9_999, 10_005) == values["a"][9_999:]).all() and archive.rows(tensors["a"], 10_000, 10_005).shape == (0, 6)
        assert archive.rows(tensors["turned"], 2, 5).tolist() == values["turned"][2:5].tolist()
        assert archive.rows(tensors["one"], 0, 9).tolist() == [[7]] and archive.rows(tensors["none"], 0, 5).shape == (0, 3)
