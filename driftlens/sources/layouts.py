"""Layouts of checkpoint folders: which tables a checkpoint has, and in which parts of which files they lie.

* state dicts: ``state_dict.pt`` or ``checkpoint.pt``, one archive of all tensors;
* sharded: ``.metadata``, a pickle that says which rows of which tensor lie in which file, from which byte on, and
  ``__<rank>_<n>.distcp`` files, one archive after another.

A table is an id map (ids and slots, with counts or without) and a weight whose rows are the slots. Id maps without a weight
are left out; weights without an id map and all other tensors are dense tensors, known by their whole names, with row numbers as
ids and slots. ``global_step`` of ``meta.json`` is a checkpoint's step in both layouts.
"""

from __future__ import annotations

import collections
import io
import json
import pickle
import zipfile
from typing import NamedTuple

from driftlens.operators.series import DENSE
from driftlens.sources.archives import Archive, Part, Tensor, open_file, open_path, read_whole

#: Key prefixes, buffer names and file names of the format.
MAP_PREFIX, WEIGHT_PREFIX, WEIGHT_SUFFIX = "_managed_collision_collection._managed_collision_modules.", "_embedding_module.embeddings.", ".weight"
IDS, SLOTS, COUNTS, DELIMITER = "_mch_sorted_raw_ids", "_mch_remapped_ids_mapping", "_mch_counts", "_delimiter"
FILES, METADATA, STEPS = ("state_dict.pt", "checkpoint.pt"), ".metadata", "meta.json"
EMPTY = 2**63 - 1
_BROKEN = (OSError, zipfile.BadZipFile, pickle.UnpicklingError, EOFError, AttributeError, StopIteration, KeyError, ValueError)


class Table(NamedTuple):
    """Parts of the id map's buffers, by name (none: a dense tensor), and of the vectors."""

    name: str
    maps: dict[str, list[Part]]
    vectors: list[Part]

    def size(self, buffer: str) -> int:
        return sum(p.n for p in self.maps[buffer])

    @property
    def slots(self) -> int:
        return sum(p.n for p in self.vectors)


def tables_of(tensors: dict[str, list[Part]]) -> list[Table]:
    """Tables of a checkpoint's tensors, given as their parts in order."""
    maps: dict[str, dict[str, list[Part]]] = {}
    for name, parts in tensors.items():
        if name.startswith(MAP_PREFIX):
            table, _, buffer = name[len(MAP_PREFIX) :].rpartition(".")
            maps.setdefault(table, {})[buffer] = parts
    found = []
    for name, parts in tensors.items():
        if name.startswith(MAP_PREFIX):
            continue
        table = name[len(WEIGHT_PREFIX) : -len(WEIGHT_SUFFIX)] if name.startswith(WEIGHT_PREFIX) and name.endswith(WEIGHT_SUFFIX) else None
        if table in maps and {IDS, SLOTS} <= set(maps[table]):
            own = Table(table, maps[table], parts)
            if own.size(IDS) != own.size(SLOTS):
                raise ValueError(f"{table}: ids and slots differ in shape")
            found.append(own)
        else:
            found.append(Table(f"{DENSE}{name}", {}, parts))
    return found


# --- state dicts ----------------------------------------------------------------------------------------------------


def state_tensors(path: str) -> dict[str, list[Part]]:
    """Tensors of a state dict; other entries are left out."""
    with open_file(path) as f:
        found = Archive(f).load()
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no state dict")
    return {k: [Part(path, 0, None, v, 0, v.rows)] for k, v in found.items() if isinstance(v, Tensor)}


# --- sharded --------------------------------------------------------------------------------------------------------


class _Parts:
    """Stands in for any class of the metadata's pickle: keeps positional arguments and state."""

    def __init__(self, *args):
        self.args = args

    def __setstate__(self, state):
        self.__dict__.update(state if isinstance(state, dict) else {"state": state})


class _Key(_Parts):
    """The index of a stored part: (tensor, offset)."""

    def __hash__(self):
        return hash(repr(self.__dict__.get("fqn")))


#: Names that may stand in the metadata's pickle.
_KNOWN = {"Metadata", "TensorStorageMetadata", "BytesStorageMetadata", "ChunkStorageMetadata", "TensorProperties", "_MEM_FORMAT_ENCODING", "StorageMeta", "_StorageInfo"}


class _MetadataReader(pickle.Unpickler):
    def find_class(self, module: str, name: str):
        if (module, name) == ("collections", "OrderedDict"):
            return collections.OrderedDict
        if (module, name) == ("torch", "Size"):
            return tuple
        if module.startswith("torch.distributed.checkpoint.") and name == "MetadataIndex":
            return _Key
        if module.startswith("torch.distributed.checkpoint.") and name in _KNOWN:
            return _Parts
        if module == "torch" and name.islower():
            return name  # a data type
        if (module, name) == ("torch.serialization", "_get_layout"):
            return str
        if module.startswith("pathlib") and name in ("PosixPath", "PurePosixPath"):
            return _Parts
        raise pickle.UnpicklingError(f"not allowed: {module}.{name}")


def sharded_tensors(folder: str) -> dict[str, list[Part]]:
    """Tensors of a sharded checkpoint, from its metadata alone."""
    meta = _MetadataReader(io.BytesIO(read_whole(f"{folder}/{METADATA}"))).load()
    found: dict[str, dict[int, Part]] = {}
    for key, info in meta.storage_data.items():
        tensor = meta.state_dict_metadata.get(key.fqn)
        if tensor is None or not hasattr(tensor, "chunks"):
            continue
        offset = tuple(key.offset or ())
        same = [c for c in tensor.chunks if tuple(c.offsets) == offset or not offset]
        if not same:
            raise ValueError(f"{key.fqn}: no chunk at {offset}")
        # of an empty and another chunk at one offset, the other one is stored
        first, n = (offset or (0,))[0], max((tuple(c.sizes) or (1,))[0] for c in same)
        if n:  # a replicated row may be stored by more than one rank
            found.setdefault(key.fqn, {})[first] = Part(f"{folder}/{info.relative_path}", info.offset, info.length, None, first, n)
        else:  # empty ranks store nothing, and an empty tensor has no part
            found.setdefault(key.fqn, {})
    return {name: [parts[k] for k in sorted(parts)] for name, parts in found.items()}


# --- folders --------------------------------------------------------------------------------------------------------


class Checkpoint(NamedTuple):
    folder: str
    file: str
    sharded: bool

    def tensors(self) -> dict[str, list[Part]]:
        return sharded_tensors(self.folder) if self.sharded else state_tensors(self.file)

    def step(self) -> int | None:
        try:
            step = json.loads(read_whole(f"{self.folder}/{STEPS}")).get("global_step")
        except FileNotFoundError:
            return None
        return None if step is None else int(step)


def checkpoints_of(path: str) -> list[Checkpoint]:
    """Checkpoints under path in the order of their folders' names, or that in the file path; of two state dicts in one folder the first of FILES."""
    import pyarrow.fs as fs

    path = path.rstrip("/")
    if path.endswith(".pt"):
        return [Checkpoint(path.rpartition("/")[0], path, False)]
    store, inside = open_path(path)
    files = store.get_file_info(fs.FileSelector(inside, recursive=True, allow_not_found=True))
    found: dict[str, Checkpoint] = {}
    for name in (*FILES[::-1], METADATA):
        for f in files:
            if f.base_name == name and f.is_file:
                folder = path + f.path.rpartition("/")[0].removeprefix(inside.rstrip("/"))
                found[folder] = Checkpoint(folder, f"{folder}/{name}", name == METADATA)
    return [found[k] for k in sorted(found)]


def has_id_map(path: str) -> bool:
    """Whether the first checkpoint under path, if there is one, has an id map: a look at names, no tensor is read."""
    found = checkpoints_of(path)
    try:
        return bool(found) and any(k.startswith(MAP_PREFIX) for k in found[0].tensors())
    except _BROKEN:
        return False
