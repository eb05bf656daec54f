"""Tasks of one barrier stage that exchange numbers with each other, and kernel rows spread over them."""

from __future__ import annotations

import os
import socket
import threading

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows for which another task is worth its exchange.
ROWS_A_TASK = 2000
#: Bytes of other tasks' numbers that a task holds at a time.
HALO_BYTES = 128 << 20
#: Rows whose products are made at a time.
BLOCK = 500


def tasks(df: DataFrame, rows: int) -> int:
    """Two thirds of the slots, so that a stage can start again after an executor is lost; fewer for few rows."""
    return max(1, min(df.sparkSession.sparkContext.defaultParallelism * 2 // 3, -(-rows // ROWS_A_TASK)))


class Mesh:
    """A connection between every two tasks of the stage.

    Where each listens, and a secret, is told by the stage's own exchange. A task that is lost
    breaks the connections, the others fail with it, and Spark starts the stage again.
    """

    def __init__(self, context):
        infos = context.getTaskInfos()
        self.me, self.n = context.partitionId(), len(infos)
        self.links: dict[int, socket.socket] = {}
        if self.n == 1:
            return
        server, secret = socket.create_server(("", 0), backlog=self.n), os.urandom(16).hex()
        server.settimeout(600)
        told = [m.split() for m in context.allGather(f"{infos[self.me].address.split(':')[0]} {server.getsockname()[1]} {secret}")]
        for p in range(self.me):
            link = socket.create_connection((told[p][0], int(told[p][1])), timeout=600)
            link.sendall(told[p][2].encode() + self.me.to_bytes(4, "big"))
            self.links[p] = link
        while len(self.links) < self.n - 1:
            link, _ = server.accept()
            link.settimeout(600)
            hello = bytes(self._read(link, len(secret) + 4))
            if hello[:-4] == secret.encode():
                self.links[int.from_bytes(hello[-4:], "big")] = link
            else:
                link.close()
        server.close()
        for link in self.links.values():
            link.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)

    @staticmethod
    def _read(link, size: int) -> bytearray:
        out = bytearray(size)
        view, at = memoryview(out), 0
        while at < size:
            got = link.recv_into(view[at:])
            if not got:
                raise ConnectionError("another task of the stage has ended")
            at += got
        return out

    def swap(self, give, dtype):
        """Yield (task, its array for this one) for every other task; ``give``: function of the task, what goes to it."""
        for d in range(1, self.n):
            to, source = (self.me + d) % self.n, (self.me - d) % self.n
            data = np.ascontiguousarray(give(to), dtype)
            failed: list[BaseException] = []

            def send(link=self.links[to], data=data, failed=failed):
                try:
                    link.sendall(len(data.ravel()).to_bytes(8, "big"))
                    link.sendall(memoryview(data).cast("B") if data.size else b"")
                except BaseException as e:  # noqa: BLE001  raised below, in the task's own thread
                    failed.append(e)

            small = data.nbytes <= 4096  # fits the socket's buffer
            sender = None if small else threading.Thread(target=send)
            if small:
                send()
            else:
                sender.start()
            size = int.from_bytes(self._read(self.links[source], 8), "big")
            got = np.frombuffer(self._read(self.links[source], size * np.dtype(dtype).itemsize), dtype)
            if sender:
                sender.join()
            if failed:
                raise failed[0]
            yield source, got

    def every(self, mine: np.ndarray) -> list[np.ndarray]:
        """The flat arrays of all tasks, in their order."""
        out = {self.me: np.ascontiguousarray(mine).ravel()} | dict(self.swap(lambda _: mine, mine.dtype))
        return [out[p] for p in range(self.n)]

    def total(self, mine: np.ndarray) -> np.ndarray:
        """Sum over the tasks, added in the same order everywhere."""
        return sum(self.every(mine)).reshape(mine.shape)

    def first(self, mine: np.ndarray) -> np.ndarray:
        """The first task's array."""
        return self.every(mine)[0].reshape(mine.shape)

    def close(self) -> None:
        for link in self.links.values():
            link.close()


class Rows:
    """A task's rows (i, j, w) of a square sparse matrix, whose rows are spread over the tasks of a mesh."""

    def __init__(self, mesh: Mesh, batches):
        self.mesh = mesh
        t = pa.Table.from_batches(batches) if batches else pa.table({"i": pa.array([], pa.int64()), "j": pa.array([], pa.int64()), "w": pa.array([], pa.float64())})
        i, j, w = (t.column(c).to_numpy() for c in "ijw")
        del t, batches
        self.ids, i = np.unique(i, return_inverse=True)
        degree = np.bincount(i, minlength=len(self.ids))
        order = np.argsort(degree, kind="stable")  # rows of one length stand together
        self.ids, degree = self.ids[order], degree[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        i = place[i]
        order = np.lexsort((j, i))
        self.row, j, self.w = i[order].astype(np.int32), j[order], w[order]
        del i, w, order
        self.ptr = np.r_[0, np.cumsum(degree)]
        new = np.flatnonzero(np.r_[True, degree[1:] != degree[:-1]]) if len(degree) else np.empty(0, int)
        self.runs = [(a, z, degree[a]) for a, z in zip(new, np.r_[new[1:], len(degree)] if len(new) else new, strict=True)]
        other, col = np.unique(j, return_inverse=True)
        del j
        at, known = self._places(self.ids, other)
        slot = np.where(known, at, -1)
        self.give, self.halo = {}, {}
        self.outside, need = len(self.ids), {}
        owner, where, names = [np.full(len(self.ids), mesh.me)], [np.arange(len(self.ids))], [self.ids]
        for p, ids in mesh.swap(lambda _: self.ids, np.int64):
            at, known = self._places(ids, other)
            self.halo[p] = np.arange(self.outside, self.outside + known.sum())
            slot[known] = self.halo[p]
            self.outside += int(known.sum())
            need[p] = at[known]
            owner.append(np.full(len(need[p]), p))
            where.append(need[p])
            names.append(other[known])
        #: Of each row in the order of ``spread``: its task, its place there, its id.
        self.owner, self.where, self.names = (np.concatenate(x) for x in (owner, where, names))
        for p, asked in mesh.swap(lambda p: need[p], np.int64):
            self.give[p] = asked
        if (slot < 0).any():
            raise ValueError("the matrix has columns without a row")
        self.col = slot[col].astype(np.int32)

    @staticmethod
    def _places(ids: np.ndarray, wanted: np.ndarray):
        """Where each wanted id stands among ``ids``, which are distinct, and whether it does."""
        if not len(ids):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        order = np.argsort(ids, kind="stable")
        at = np.minimum(np.searchsorted(ids, wanted, sorter=order), len(ids) - 1)
        at = order[at]
        return at, ids[at] == wanted

    def sums(self) -> np.ndarray:
        return np.bincount(self.row, self.w, len(self.ids)).astype(float)

    def spread(self, x: np.ndarray) -> np.ndarray:
        """Own rows of x, then those of other tasks that this one's columns name."""
        out = np.empty((self.outside, x.shape[1]))
        out[: len(x)] = x
        for p, got in self.mesh.swap(lambda p: x.take(self.give[p], axis=0), np.float64):
            out[self.halo[p]] = got.reshape(-1, x.shape[1])
        return out

    def times(self, x: np.ndarray) -> np.ndarray:
        """Own rows of the product with x (own rows of it), some columns at a time where the others' rows are many."""
        out, wide = np.empty_like(x), max(1, HALO_BYTES // (8 * max(1, self.outside)))
        for c in range(0, x.shape[1], wide):
            part = self.spread(np.ascontiguousarray(x[:, c : c + wide]))
            for a, z, d in self.runs:
                for s in range(a, z, max(1, BLOCK * 16 // d)):
                    e = min(z, s + max(1, BLOCK * 16 // d))
                    lo, hi = self.ptr[s], self.ptr[e]
                    near = part.take(self.col[lo:hi], axis=0, mode="clip").reshape(e - s, d, -1)
                    out[s:e, c : c + wide] = np.matmul(self.w[lo:hi].reshape(e - s, 1, d), near)[:, 0]
        return out

    def fetched(self, slots: np.ndarray):
        """Begin, end, columns' ids and values of the rows at some places of ``spread``; all tasks ask at once."""
        asked = dict(self.mesh.swap(lambda p: self.where[slots[self.owner[slots] == p]], np.int64)) | {self.mesh.me: self.where[slots[self.owner[slots] == self.mesh.me]]}
        at = {p: _ranges(self.ptr[x], self.ptr[x + 1]) for p, x in asked.items()}
        size, j, w = (
            np.empty(len(slots), np.int64),
            dict(self.mesh.swap(lambda p: self.names[self.col[at[p]]], np.int64)) | {self.mesh.me: self.names[self.col[at[self.mesh.me]]]},
            dict(self.mesh.swap(lambda p: self.w[at[p]], np.float64)) | {self.mesh.me: self.w[at[self.mesh.me]]},
        )
        sizes = dict(self.mesh.swap(lambda p: self.ptr[asked[p] + 1] - self.ptr[asked[p]], np.int64)) | {self.mesh.me: self.ptr[asked[self.mesh.me] + 1] - self.ptr[asked[self.mesh.me]]}
        begin, base = np.empty(len(slots), np.int64), 0
        for p in range(self.mesh.n):
            mine = self.owner[slots] == p
            size[mine] = sizes[p]
            begin[mine] = base + np.cumsum(sizes[p]) - sizes[p]
            base += int(sizes[p].sum())
        return begin, begin + size, np.concatenate([j[p] for p in range(self.mesh.n)]), np.concatenate([w[p] for p in range(self.mesh.n)])

    def squared(self, some: int = 2000):
        """Yield (ids of rows, row, id of column, value) of the product with itself, some rows at a time."""
        n = len(self.ids)
        for s in range(0, max(len(x) and int(x[0]) for x in self.mesh.every(np.array([n]))), some):
            s, e = min(s, n), min(n, s + some)
            col = self.col[self.ptr[s] : self.ptr[e]]
            slots, at = np.unique(col, return_inverse=True)
            begin, end, j, w = self.fetched(slots)
            size = (end - begin)[at]
            pos = _ranges(begin[at], end[at])
            ids, j = np.unique(j, return_inverse=True)
            key = np.repeat(self.row[self.ptr[s] : self.ptr[e]].astype(np.int64) - s, size) * max(1, len(ids)) + j[pos]
            value = np.repeat(self.w[self.ptr[s] : self.ptr[e]], size) * w[pos]
            key, at = np.unique(key, return_inverse=True)
            yield self.ids[s:e], key // max(1, len(ids)), ids[key % max(1, len(ids))] if len(ids) else ids, np.bincount(at, value, len(key)).astype(float)


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    c = hi - lo
    return np.arange(c.sum()) + np.repeat(lo - np.cumsum(c) + c, c)
