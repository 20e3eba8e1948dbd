"""Exchange of sorted integers: tasks send them Golomb-coded to the owners of their ranges, and owners return bitmaps of those that occur more than once."""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import golomb

REQUEST = "chunk long, owner long, n long, width long, blob binary, twice binary"


def requests(values: np.ndarray, twice: np.ndarray, chunk: int, owners: int, bits: int) -> list[dict]:
    """Rows for ascending distinct values below 2**bits; twice: those that the sender itself holds more than once."""
    step = -(-(1 << bits) // owners)
    owner = values // step
    edges = np.flatnonzero(np.diff(owner, prepend=-1, append=owners))
    rows = []
    for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        width, blob = golomb.encode(values[i:j] - owner[i] * step)
        rows.append({"chunk": chunk, "owner": int(owner[i]), "n": j - i, "width": width, "blob": blob, "twice": np.packbits(twice[i:j]).tobytes()})
    return rows


def request_schema() -> pa.Schema:
    return pa.schema([(x.split()[0], pa.binary() if x.endswith("binary") else pa.int64()) for x in REQUEST.split(", ")])


def flags(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8))[:n].astype(bool)


def answers(rows: DataFrame) -> DataFrame:
    """chunk, owner, bitmap: which of a request's values occur more than once in all."""
    def own(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        values = [golomb.decode(r["n"], r["width"], r["blob"]) for r in rows]
        kinds, where, counts = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
        twice = counts > 1
        twice[where[np.concatenate([flags(r["twice"], r["n"]) for r in rows])]] = True
        maps = [np.packbits(h).tobytes() for h in np.split(twice[where], np.cumsum([r["n"] for r in rows])[:-1])]
        return pa.table({"chunk": table["chunk"], "owner": table["owner"], "bitmap": pa.array(maps, pa.binary())})

    return rows.groupBy("owner").applyInArrow(own, "chunk long, owner long, bitmap binary")
