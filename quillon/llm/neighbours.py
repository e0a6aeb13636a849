"""Approximate nearest neighbours: NN-descent and greedy graph search.

Nearness is the inner product. Equal vectors form one point, so that a vector
held by many rows is compared once. NN-descent starts from the nearest within
random blocks. In each turn every point meets its neighbours and those that it
is a neighbour of; all that meet at one point are compared, and each keeps the
nearest it has met, until a turn changes little. A query then walks the graph:
it looks at the neighbours of the nearest points found so far that it hasn't
looked at, until all that it keeps have been looked at. For a fixed set of queries
the true nearest are found by comparing with every point, in blocks; while too
few of them are among those kept, these queries keep twice as many; all others then walk with as many.

Points are dealt by id into parts of bounded size. Lists of ids and vectors travel
between parts as packed arrays, one row for each pair of parts, and each turn or
step is a few Spark joins on the part. Inside, vectors are signed bytes with a scale;
what a query finds is scored again on the original vectors in double precision.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import give_back, materialise

#: Neighbours that a point keeps in the graph.
WIDTH = 32
#: Of the points that point to a point, so many meet there, chosen by hash.
HUB = 32
#: Points compared with one another at the start, and how often they are dealt anew for that.
START, WAYS = 256, 3
#: A turn that changes less than SETTLED of all neighbours is the last; so is one after TURNS for each doubling of the points.
TURNS, SETTLED = 2, 0.02
#: Nearest points found that a query keeps at first.
BEAM = 224
#: Queries compared with every point, and the share of their nearest that must be found.
CHECKED, RECALL = 200, 0.95
#: Nearest that a part of the meetings reports for a point.
REPORT = 12
#: Points in a part, about.
PART = 2048
#: Points from which a query starts that isn't in the index.
ENTRIES = 64
_GOLD = np.uint64(0x9E3779B97F4A7C15)

_ROW = "part int, kind string, ids binary, mets binary, scores binary, codes binary, scales binary, flags binary"
_COLS = [c.split()[0] for c in _ROW.split(", ")]


def _hash(ids: np.ndarray, seed: int = 0) -> np.ndarray:
    h = (ids.astype(np.uint64) + np.uint64(seed)) * _GOLD
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _part(ids: np.ndarray, parts: int) -> np.ndarray:
    return (_hash(ids) % np.uint64(parts)).astype(np.int64)


def _row(part: int, kind: str, **arrays: np.ndarray) -> dict:
    return {"part": int(part), "kind": kind} | {k: v.tobytes() for k, v in arrays.items()}


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLS).astype(object).where(lambda d: d.notna(), None) if rows else pd.DataFrame(columns=_COLS)


def _cat(rows: pd.DataFrame, col: str, kind: str) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *(np.frombuffer(b, kind) for b in rows[col])])


def _best(ids: np.ndarray, mets: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of each id's k best different mets: highest score, then least met."""
    order = np.lexsort((mets, -scores, ids))
    i, m = ids[order], mets[order]
    # An equal pair has an equal score, so it stands next to its like.
    order = order[np.concatenate(([True], (i[1:] != i[:-1]) | (m[1:] != m[:-1])))] if len(order) else order
    i = ids[order]
    first = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1]))) if len(i) else np.empty(0, int)
    return order[np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i)))) < k]


def _hub(at: np.ndarray, member: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Positions of HUB members of each point: fresh ones first, then by hash. What is cut from a part of them is cut from all."""
    order = np.lexsort((_hash(member, 1) ^ _hash(at, 2), ~fresh, at))
    i = at[order]
    first = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1]))) if len(i) else np.empty(0, int)
    return order[np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i)))) < HUB]


def _quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scale = np.abs(x).max(1) / 127
    scale[scale == 0] = 1
    return np.rint(x / scale[:, None]).astype(np.int8), scale.astype(np.float32)


class _Part:
    """The points of one part with their lists."""

    def __init__(self, rows: pd.DataFrame, dim: int, width: int):
        s = rows[rows["kind"] == "state"].iloc[0]
        self.ids = np.frombuffer(s["ids"], np.int64)
        n = len(self.ids)
        self.codes = np.frombuffer(s["codes"], np.int8).reshape(n, dim)
        self.scales = np.frombuffer(s["scales"], np.float32)
        self.mets = np.frombuffer(s["mets"], np.int64).reshape(n, width)
        self.scores = np.frombuffer(s["scores"], np.float32).reshape(n, width)
        self.fresh = np.frombuffer(s["flags"], bool).reshape(n, width)

    def row(self, part: int) -> dict:
        return _row(part, "state", ids=self.ids, codes=self.codes, scales=self.scales, mets=self.mets, scores=self.scores, flags=self.fresh)


class Graph:
    """A neighbour graph over points (id long, vec array<double>) of one length, ids distinct."""

    def __init__(self, points: DataFrame, dim: int, width: int = WIDTH, turns: int | None = None):
        self.recall, self.beam = None, None  # of the last search
        self.dim, self.width, self.points = dim, width, points
        self.size = points.count()
        self.parts = max(1, -(-self.size // PART))
        self.rows = self._start()
        for _ in range(TURNS * self.size.bit_length() if turns is None else turns):
            if self.size < 2 or self._turn() < SETTLED * self.size * min(width, self.size - 1):
                break

    def _by_part(self, fn, *frames: DataFrame) -> DataFrame:
        both = frames[0]
        for f in frames[1:]:
            both = both.unionByName(f)
        return both.groupBy("part").applyInPandas(fn, _ROW)

    def _start(self) -> DataFrame:
        """Each point's nearest within a random block, as state rows."""
        dim, width, parts = self.dim, self.width, self.parts
        blocks = max(1, -(-self.size // START))

        def compare(rows: pd.DataFrame) -> pd.DataFrame:
            ids = rows["id"].to_numpy(np.int64)
            codes, scales = _quantised(np.stack(rows["vec"].to_numpy()))
            x = codes.astype(np.float32) * scales[:, None]
            mets, scores = np.full((len(ids), width), -1, np.int64), np.full((len(ids), width), -np.inf, np.float32)
            for at in range(0, len(ids), START):
                near = x[at : at + START] @ x.T
                near[np.arange(len(near)), np.arange(at, at + len(near))] = -np.inf
                k = min(width, len(ids) - 1)
                top = np.argsort(-near, axis=1)[:, :k]
                mets[at : at + START, :k], scores[at : at + START, :k] = ids[top], np.take_along_axis(near, top, 1)
            dealt, out = _part(ids, parts), []
            for p in np.unique(dealt):
                own = dealt == p
                out.append(_row(p, "piece", ids=ids[own], codes=codes[own], scales=scales[own], mets=mets[own], scores=scores[own]))
            return _frame(out)

        def gather(rows: pd.DataFrame) -> pd.DataFrame:
            ids, where = np.unique(_cat(rows, "ids", np.int64), return_index=True)
            codes, scales = _cat(rows, "codes", np.int8).reshape(-1, dim)[where], _cat(rows, "scales", np.float32)[where]
            m, v = _cat(rows, "mets", np.int64), _cat(rows, "scores", np.float32)
            i = np.repeat(_cat(rows, "ids", np.int64), width)[m >= 0]
            m, v = m[m >= 0], v[m >= 0]
            keep = _best(i, m, v, width)
            row = np.searchsorted(ids, i[keep])
            col = np.arange(len(row)) - np.searchsorted(row, np.arange(len(ids)))[row]
            mets, scores = np.full((len(ids), width), -1, np.int64), np.full((len(ids), width), -np.inf, np.float32)
            mets[row, col], scores[row, col] = m[keep], v[keep]
            return _frame([_row(rows["part"].iloc[0], "state", ids=ids, codes=codes, scales=scales, mets=mets, scores=scores, flags=mets >= 0)])

        # Blocks dealt several ways: else the neighbours of neighbours would all be in one block.
        ways = F.explode(F.transform(F.sequence(F.lit(1), F.lit(WAYS)), lambda w: F.struct(w.alias("way"), F.pmod(F.xxhash64("id", w), F.lit(blocks)).alias("block"))))
        pieces = self.points.withColumn("_b", ways).groupBy("_b").applyInPandas(compare, _ROW)
        return materialise(self._by_part(gather, pieces), "ann-state")

    def _turn(self) -> int:
        """One turn; returns how many neighbours changed."""
        dim, width, parts = self.dim, self.width, self.parts
        state = self.rows

        def point_back(rows: pd.DataFrame) -> pd.DataFrame:
            """Tell each neighbour who points to it: of a part at most HUB, however popular it is."""
            s, out = _Part(rows, dim, width), []
            here = s.mets >= 0
            at, member, fresh = s.mets[here], np.repeat(s.ids, here.sum(1)), s.fresh[here]
            kept = _hub(at, member, fresh)
            at, member, fresh = at[kept], member[kept], fresh[kept]
            dealt = _part(at, parts)
            for p in np.unique(dealt):
                own = dealt == p
                out.append(_row(p, "back", ids=at[own], mets=member[own], flags=fresh[own]))
            return _frame(out)

        def invite(rows: pd.DataFrame) -> pd.DataFrame:
            """Who meets where; and whose vectors that takes."""
            part, s, back = rows["part"].iloc[0], _Part(rows, dim, width), rows[rows["kind"] == "back"]
            here = s.mets >= 0
            at, member, fresh = _cat(back, "ids", np.int64), _cat(back, "mets", np.int64), _cat(back, "flags", bool)
            order = _hub(at, member, fresh)
            at = np.concatenate((np.repeat(s.ids, here.sum(1)), at[order]))
            member, fresh = np.concatenate((s.mets[here], member[order])), np.concatenate((s.fresh[here], fresh[order]))
            order = np.lexsort((~fresh, member, at))
            at, member, fresh = at[order], member[order], fresh[order]
            if len(at):
                new = np.concatenate(([True], (at[1:] != at[:-1]) | (member[1:] != member[:-1])))
                at, member, fresh = at[new], member[new], fresh[new]
                some = np.isin(at, np.unique(at[fresh]))
                at, member, fresh = at[some], member[some], fresh[some]
            out = [_row(part, "entry", ids=at, mets=member, flags=fresh)]
            need = np.unique(member)
            dealt = _part(need, parts)
            for p in np.unique(dealt):
                own = need[dealt == p]
                out.append(_row(p, "ask", ids=own, mets=np.array([part], np.int64)))
            return _frame(out)

        def answer(rows: pd.DataFrame) -> pd.DataFrame:
            s, out = _Part(rows, dim, width), []
            for ids, to in zip(rows.loc[rows["kind"] == "ask", "ids"], rows.loc[rows["kind"] == "ask", "mets"], strict=True):
                ids = np.frombuffer(ids, np.int64)
                at = np.searchsorted(s.ids, ids)
                out.append(_row(np.frombuffer(to, np.int64)[0], "code", ids=ids, codes=s.codes[at], scales=s.scales[at], scores=s.scores[at, -1]))
            return _frame(out)

        def meet(rows: pd.DataFrame) -> pd.DataFrame:
            entry, code = rows[rows["kind"] == "entry"], rows[rows["kind"] == "code"]
            at, member, fresh = _cat(entry, "ids", np.int64), _cat(entry, "mets", np.int64), _cat(entry, "flags", bool)
            ids = _cat(code, "ids", np.int64)
            order = np.argsort(ids)
            ids, floor = ids[order], _cat(code, "scores", np.float32)[order]
            x = _cat(code, "codes", np.int8).reshape(-1, dim)[order].astype(np.float32) * _cat(code, "scales", np.float32)[order][:, None]
            slot = np.searchsorted(ids, member)
            first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.empty(0, int)
            got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            held = 0

            def cut() -> None:
                i, m, v = map(np.concatenate, zip(*got))
                keep = _best(i, m, v, REPORT)
                got[:] = [(i[keep], m[keep], v[keep])]

            for lo, hi in zip(first, np.append(first[1:], len(at))):
                k, f = slot[lo:hi], fresh[lo:hi]
                y = x[k]
                near = y @ y.T
                use = (near > floor[k][:, None]) & (f[:, None] | f[None, :])
                np.fill_diagonal(use, False)
                r, c = np.nonzero(use)
                if len(r):
                    got.append((k[r].astype(np.int32), k[c].astype(np.int32), near[r, c]))
                    held += len(r)
                    if held > 1_000_000:
                        cut()
                        held = len(got[0][0])
            if not got:
                return _frame([])
            cut()
            i, m, v = ids[got[0][0]], ids[got[0][1]], got[0][2]
            dealt, out = _part(i, parts), []
            for p in np.unique(dealt):
                own = dealt == p
                out.append(_row(p, "new", ids=i[own], mets=m[own], scores=v[own].astype(np.float32)))
            return _frame(out)

        def merge(rows: pd.DataFrame) -> pd.DataFrame:
            part, s, new = rows["part"].iloc[0], _Part(rows, dim, width), rows[rows["kind"] == "new"]
            here = s.mets >= 0
            i = np.concatenate((np.repeat(s.ids, here.sum(1)), _cat(new, "ids", np.int64)))
            m = np.concatenate((s.mets[here], _cat(new, "mets", np.int64)))
            v = np.concatenate((s.scores[here], _cat(new, "scores", np.float32)))
            known = np.arange(len(i)) < here.sum()
            # The old entry of an equal pair stays: it has met already.
            order = np.lexsort((~known, m, i))
            i, m, v, known = i[order], m[order], v[order], known[order]
            one = np.concatenate(([True], (i[1:] != i[:-1]) | (m[1:] != m[:-1])))
            i, m, v, known = i[one], m[one], v[one], known[one]
            keep = _best(i, m, v, width)
            i, m, v, known = i[keep], m[keep], v[keep], known[keep]
            row = np.searchsorted(s.ids, i)
            first = np.searchsorted(row, np.arange(len(s.ids)))
            col = np.arange(len(row)) - first[row]
            s.mets, s.scores, s.fresh = np.full_like(s.mets, -1), np.full_like(s.scores, -np.inf), np.zeros_like(s.fresh)
            s.mets[row, col], s.scores[row, col], s.fresh[row, col] = m, v, ~known
            give_back()
            return _frame([s.row(part)])

        backs = state.groupBy("part").applyInPandas(point_back, _ROW)
        plan = materialise(self._by_part(invite, state, backs), "ann-meet")
        codes = self._by_part(answer, state, plan.where("kind = 'ask'"))
        news = self._by_part(meet, plan.where("kind = 'entry'"), codes)
        self.rows = materialise(self._by_part(merge, state, news), "ann-state")
        flags = self.rows.select(F.length(F.regexp_replace(F.hex("flags"), "00", "")) / 2)
        return int(flags.groupBy().sum().first()[0] or 0)

    def _lists(self) -> DataFrame:
        """State rows whose codes and scales are those of the neighbours."""
        dim, width, parts = self.dim, self.width, self.parts

        def ask(rows: pd.DataFrame) -> pd.DataFrame:
            s, part, out = _Part(rows, dim, width), rows["part"].iloc[0], []
            need = np.unique(s.mets[s.mets >= 0])
            dealt = _part(need, parts)
            for p in np.unique(dealt):
                out.append(_row(p, "ask", ids=need[dealt == p], mets=np.array([part], np.int64)))
            return _frame(out)

        def answer(rows: pd.DataFrame) -> pd.DataFrame:
            s, out = _Part(rows, dim, width), []
            for ids, to in zip(rows.loc[rows["kind"] == "ask", "ids"], rows.loc[rows["kind"] == "ask", "mets"], strict=True):
                ids = np.frombuffer(ids, np.int64)
                at = np.searchsorted(s.ids, ids)
                out.append(_row(np.frombuffer(to, np.int64)[0], "code", ids=ids, codes=s.codes[at], scales=s.scales[at]))
            return _frame(out)

        def attach(rows: pd.DataFrame) -> pd.DataFrame:
            s, code = _Part(rows, dim, width), rows[rows["kind"] == "code"]
            ids = _cat(code, "ids", np.int64)
            order = np.argsort(ids)
            codes, scales = _cat(code, "codes", np.int8).reshape(-1, dim)[order], _cat(code, "scales", np.float32)[order]
            if not len(ids):
                return _frame([])
            at = np.minimum(np.searchsorted(ids[order], s.mets), len(ids) - 1)
            return _frame([_row(rows["part"].iloc[0], "list", ids=s.ids, mets=s.mets, codes=codes[at], scales=scales[at])])

        asks = self.rows.groupBy("part").applyInPandas(ask, _ROW)
        return materialise(self._by_part(attach, self.rows, self._by_part(answer, self.rows, asks)), "ann-lists")

    def _truth(self, queries: DataFrame, k: int) -> dict[int, np.ndarray]:
        """The k nearest of every point for CHECKED queries, those whose ids hash lowest; the query's own point doesn't count."""
        some = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(CHECKED).collect()
        if not some:
            return {}
        names, own = np.array([r["query_id"] for r in some], np.int64), np.array([-1 if r["at"] is None else r["at"] for r in some], np.int64)
        q = np.array([r["vec"] for r in some])

        def compare(batches):
            ids, scores = np.full((len(q), 0), -1, np.int64), np.empty((len(q), 0))
            for batch in batches:
                for lo in range(0, len(batch), 4096):
                    one = batch.iloc[lo : lo + 4096]
                    i = np.broadcast_to(one["id"].to_numpy(np.int64), (len(q), len(one)))
                    near = np.where(i == own[:, None], -np.inf, q @ np.stack(one["vec"].to_numpy()).T)
                    ids, scores = np.hstack((ids, i)), np.hstack((scores, near))
                    top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                    ids, scores = np.take_along_axis(ids, top, 1), np.take_along_axis(scores, top, 1)
            here = scores > -np.inf
            yield pd.DataFrame({"query_id": np.repeat(names, here.sum(1)), "id": ids[here], "score": scores[here]})

        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        best = self.points.mapInPandas(compare, "query_id long, id long, score double").withColumn("nr", place).where(F.col("nr") <= k)
        got: dict[int, list[int]] = {}
        for r in best.select("query_id", "id").collect():  # CHECKED times k
            got.setdefault(r[0], []).append(r[1])
        return {i: np.array(m, np.int64) for i, m in got.items()}

    def search(self, queries: DataFrame, beam: int | None = None, look: int | None = None, k: int = 20, recall: float | None = None) -> DataFrame:
        """(query_id, id): for each query (query_id, vec, at) at least up to `beam` points found nearest.

        at is the point from which the query starts, null if it isn't indexed. In a step a query looks at
        `look` points, all that it keeps if none is said: a step goes through the whole graph, however few look.
        The checked queries walk first, and the beam is doubled until `recall` of their k nearest are in it,
        or until it has room for every point; all queries then walk with that beam. self.recall and self.beam tell how it ended.
        """
        beam, recall = beam or max(BEAM, k + 1), RECALL if recall is None else recall
        look = look or beam
        dim, width, parts = self.dim, self.width, self.parts
        lists = self._lists()
        entries = np.array([r[0] for r in self.points.select("id").orderBy(F.xxhash64("id")).limit(ENTRIES).collect()], np.int64)

        # A beam row: ids = queries, codes = their vectors as floats, mets/scores/flags = points found, looked at or not.
        def begin(rows: pd.DataFrame) -> pd.DataFrame:
            ids = rows["query_id"].to_numpy(np.int64)
            x = np.stack(rows["vec"].to_numpy()).astype(np.float32)
            mets, scores = np.full((len(ids), beam), -1, np.int64), np.full((len(ids), beam), -np.inf, np.float32)
            at = rows["at"]
            some = at.notna().to_numpy()
            mets[some, 0] = at[some].to_numpy(np.int64)
            mets[~some, : len(entries)] = entries[:beam]
            scores[mets >= 0] = -1e30  # to be looked at first, and found again with their scores
            return _frame([_row(rows["part"].iloc[0], "beam", ids=ids, codes=x, mets=mets, scores=scores, flags=np.zeros(mets.shape, bool))])

        def unpack(rows: pd.DataFrame):
            b = rows[rows["kind"] == "beam"].iloc[0]
            ids = np.frombuffer(b["ids"], np.int64)
            n = len(ids)
            return ids, np.frombuffer(b["codes"], np.float32).reshape(n, dim), np.frombuffer(b["mets"], np.int64).reshape(n, beam), np.frombuffer(b["scores"], np.float32).reshape(n, beam), np.frombuffer(b["flags"], bool).reshape(n, beam)

        def choose(mets, scores, flags) -> np.ndarray:
            """The nearest not yet looked at: beams are sorted, so the first ones."""
            todo = (mets >= 0) & ~flags
            return todo & (np.cumsum(todo, 1) <= look)

        def send(rows: pd.DataFrame) -> pd.DataFrame:
            ids, x, mets, scores, flags = unpack(rows)
            picked, out = choose(mets, scores, flags), []
            row, point = np.nonzero(picked)[0], mets[picked]
            dealt = _part(point, parts)
            for p in np.unique(dealt):
                own = dealt == p
                used, at = np.unique(row[own], return_inverse=True)
                # With each query goes the score of the last in its beam, -inf while there is room: what is below it needn't come back.
                out.append(_row(p, "look", ids=ids[used], codes=x[used], mets=point[own], scores=scores[used, -1], scales=at.astype(np.int64), flags=np.array([rows["part"].iloc[0]], np.int64)))
            return _frame(out)

        def visit(rows: pd.DataFrame) -> pd.DataFrame:
            """Score the neighbours of the points that queries look at."""
            have = rows[rows["kind"] == "list"]
            if not len(have):
                return _frame([])
            s, out = have.iloc[0], []
            ids = np.frombuffer(s["ids"], np.int64)
            mets = np.frombuffer(s["mets"], np.int64).reshape(-1, width)
            codes = np.frombuffer(s["codes"], np.int8).reshape(-1, width, dim)
            scales = np.frombuffer(s["scales"], np.float32).reshape(-1, width)
            for r in rows[rows["kind"] == "look"].itertuples():
                query, x = np.frombuffer(r.ids, np.int64), np.frombuffer(r.codes, np.float32).reshape(-1, dim)
                at, who = np.searchsorted(ids, np.frombuffer(r.mets, np.int64)), np.frombuffer(r.scales, np.int64)
                floor = np.frombuffer(r.scores, np.float32)
                got = []
                for lo in range(0, len(at), 2048):
                    a, w = at[lo : lo + 2048], who[lo : lo + 2048]
                    near = np.einsum("nkd,nd->nk", codes[a].astype(np.float32), x[w], optimize=True) * scales[a]
                    here = (mets[a] >= 0) & (near >= floor[w][:, None])
                    got.append((np.repeat(w, here.sum(1)), mets[a][here], near[here]))
                w, m, v = map(np.concatenate, zip(*got))
                keep = _best(w, m, v, beam)
                out.append(_row(np.frombuffer(r.flags, np.int64)[0], "seen", ids=query[w[keep]], mets=m[keep], scores=v[keep].astype(np.float32)))
            return _frame(out)

        def advance(rows: pd.DataFrame) -> pd.DataFrame:
            part, (ids, x, mets, scores, flags), seen = rows["part"].iloc[0], unpack(rows), rows[rows["kind"] == "seen"]
            flags = flags | choose(mets, scores, flags)
            here = mets >= 0
            order = np.argsort(ids)
            q = np.concatenate((np.repeat(np.arange(len(ids)), here.sum(1)), order[np.searchsorted(ids[order], _cat(seen, "ids", np.int64))]))
            m = np.concatenate((mets[here], _cat(seen, "mets", np.int64)))
            v = np.concatenate((scores[here], _cat(seen, "scores", np.float32)))
            f = np.concatenate((flags[here], np.zeros(len(q) - here.sum(), bool)))
            # Of an equal pair the score found counts, and whether it was looked at in either.
            order = np.lexsort((-v, m, q))
            q, m, v, f = q[order], m[order], v[order], f[order]
            first = np.flatnonzero(np.concatenate(([True], (q[1:] != q[:-1]) | (m[1:] != m[:-1]))))
            q, m, v, f = q[first], m[first], v[first], np.logical_or.reduceat(f, first)
            keep = _best(q, m, v, beam)
            q, m, v, f = q[keep], m[keep], v[keep], f[keep]
            col = np.arange(len(q)) - np.searchsorted(q, np.arange(len(ids)))[q]
            mets, scores, flags = np.full_like(mets, -1), np.full_like(scores, -np.inf), np.zeros_like(flags)
            mets[q, col], scores[q, col], flags[q, col] = m, v, f
            left = int(((mets >= 0) & ~flags).sum())
            return _frame([_row(part, "beam", ids=ids, codes=x, mets=mets, scores=scores, flags=flags, scales=np.array([left], np.int64))])

        dealt = queries.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
        truth = self._truth(queries, k)

        def counted(batches):
            """How many of the checked queries' nearest are in their beams."""
            for rows in batches:
                hits = 0
                for _, row in rows.iterrows():
                    ids, _, mets, scores, _ = unpack(row.to_frame().T)
                    hits += sum(int(np.isin(truth[int(i)], m[v > -1e30]).sum()) for i, m, v in zip(ids, mets, scores) if int(i) in truth)
                yield pd.DataFrame({"hits": [hits]})

        groups = [dealt]
        if truth and queries.count() > len(truth):
            groups.insert(0, dealt.where(F.col("query_id").isin(list(truth))))
        for some in groups:
            while True:
                beams = materialise(some.groupBy("part").applyInPandas(begin, _ROW), "ann-beams")
                while True:  # ends: what falls out of a beam doesn't come back
                    looks = beams.groupBy("part").applyInPandas(send, _ROW)
                    beams = materialise(self._by_part(advance, beams, self._by_part(visit, lists, looks)), "ann-beams")
                    if not beams.where("hex(scales) != '0000000000000000'").limit(1).count():
                        break
                hits = beams.mapInPandas(counted, "hits long").agg(F.sum("hits")).first()[0] or 0
                self.beam, self.recall = beam, hits / max(1, sum(map(len, truth.values()))) if truth else None
                if not truth or self.recall >= recall or beam >= self.size:
                    break
                beam, look = 2 * beam, 2 * look
        if truth and self.recall < recall:
            warnings.warn(f"the graph search found {self.recall:.3f} of the checked queries' nearest, less than {recall}", stacklevel=2)

        def found(rows: pd.DataFrame) -> pd.DataFrame:
            ids, _, mets, scores, _ = unpack(rows)
            here = (mets >= 0) & (scores > -1e30)
            return pd.DataFrame({"query_id": np.repeat(ids, here.sum(1)), "id": mets[here]})

        return beams.groupBy("part").applyInPandas(found, "query_id long, id long")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest that graph search finds for each row whose id is divisible by `every`.

    Returns query_id, rank (from 1), vec_id and score: the inner product of the
    original vectors in double precision, nearest first, ties to the smaller id.
    The search widens until RECALL of the nearest of CHECKED queries are found, and
    warns if they can't be. A query isn't its own neighbour. Rows with a null id, and vectors that are
    null, empty, zero or hold null or non-finite components, take no part, nor do
    vectors of another length than the most frequent. Rows that share an id are
    candidates, and queries, of their own: such queries give k rows each, and ties
    in score and id go by the order in which the rows are met. Equal vectors are one point of the
    graph and give their k + 1 first rows, which is all that k places can need. An empty
    table gives no rows; with k or fewer candidates all those found come back.
    Columns other than these two, whatever their names, are ignored.
    """
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    fine = (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.coalesce(fine, F.lit(False)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("vec"))
    rows = materialise(rows.select("id", "vec", F.xxhash64("vec").alias("same"), F.monotonically_increasing_id().alias("nr")), "ann-rows")
    # A row is named by its id, and by its number where rows share ids.
    shared = rows.groupBy("id").count().where("count > 1").limit(1).count()
    rows = rows.withColumn("row", F.col("nr" if shared else "id")).drop("nr")
    dims = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim = dims[0]["dim"] if dims else 1
    rows = rows.where(F.size("vec") == dim)
    # row_number <= k + 1 is cut before the shuffle too, so a vector with very many rows is no hot spot.
    nr = F.row_number().over(Window.partitionBy("same").orderBy("id", "row"))
    least = materialise(rows.select("same", "id", "row").withColumn("nr", nr).where(F.col("nr") <= k + 1), "ann-least")
    point = least.where("nr = 1").select(F.col("row").alias("point"), "same")
    points = materialise(rows.join(point, F.col("row") == F.col("point")).select(F.col("row").alias("id"), "vec"), "ann-points")
    # A power of two changes no digit and no order, and keeps single precision in range.
    most = rows.agg(F.max(F.array_max(F.transform("vec", F.abs)))).first()[0] or 1.0
    unit = math.ldexp(1.0, max(-1000, min(1000, -math.frexp(most)[1])))
    scaled = lambda df: df.withColumn("vec", F.transform("vec", lambda x: x * unit))
    graph = Graph(scaled(points), dim)
    asked = rows.where(F.col("id") % every == 0)
    at = asked.join(point.withColumnRenamed("same", "s"), F.col("same") == F.col("s"))
    queries = materialise(at.select(F.col("row").alias("query_id"), F.col("id").alias("asked"), "vec", F.col("point").alias("at")), "ann-queries")
    found = graph.search(scaled(queries.drop("asked")), k=k)
    # A query's own point is near it too: other rows may hold the same vector.
    pairs = found.unionByName(queries.select("query_id", F.col("at").alias("id"))).distinct()
    dot = F.aggregate(F.zip_with("q", "vec", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    own = queries.select("query_id", "asked", F.col("vec").alias("q"))
    scored = pairs.join(own, "query_id").join(points, "id").select("query_id", "asked", F.col("id").alias("point"), dot.alias("score"))
    members = point.join(least.select("same", "row", F.col("id").alias(id_col)), "same").select("point", "row", id_col)
    each = scored.join(members, "point").where(F.col("query_id") != F.col("row"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.col(id_col), "row"))
    best = each.withColumn("rank", place).where(F.col("rank") <= k)
    return best.select(F.col("asked").alias("query_id"), F.col("rank").cast("int").alias("rank"), id_col, "score")
