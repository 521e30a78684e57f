"""Forward, backward and best-path recursions over window sequences.

A trajectory is cut into blocks of ``BLOCK`` windows. A block acts on the state
vector as a K x K matrix in the (log-sum, +) or (max, +) algebra, so:

1. each block of a long trajectory is reduced to its matrix, in parallel;
2. the matrices (one small row per block) are walked to give every block the
   vector that enters it from the left and from the right; if there are many of
   them they are grouped and reduced again, level by level;
3. each block is run on its own with those vectors.

Short trajectories are a single block and skip 1 and 2. Inside a task, all
blocks of an Arrow batch advance together, one vectorised step per position.
No task ever holds more than a batch of bounded blocks.

A trajectory with a log-likelihood that is not finite is left out as a whole: its
block turns the matrices, and so the vectors that enter all its other blocks, into NaN.
Where a trajectory starts and ends is a flag of its own (no vector).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.ordering import spread
from ..schema import KEYS

BLOCK = 256
LOG_FLOOR = -1e6
CHUNK = 512

# features of a run of rows (n, width) -> log-likelihoods (n, K)
Emit = Callable[[np.ndarray], np.ndarray]


# vector steps -----------------------------------------------------------------

def _step(v: np.ndarray, M: np.ndarray, logM: np.ndarray, best: bool) -> np.ndarray:
    """(..., K) log vector times the kernel, on its last axis."""
    if best:
        return (v[..., :, None] + logM).max(axis=-2)
    m = v.max(axis=-1, keepdims=True)
    with np.errstate(divide="ignore"):
        out = m + np.log(np.exp(v - m) @ M)
    return np.maximum(out, LOG_FLOOR + m)


def _norm(v: np.ndarray, best: bool) -> tuple[np.ndarray, np.ndarray]:
    """Log normaliser and normalised vector."""
    m = v.max(axis=-1, keepdims=True)
    c = m if best else m + np.log(np.exp(v - m).sum(axis=-1, keepdims=True))
    return c[..., 0], v - c


class Kernel:
    """Start weights and transition kernel in log and linear form."""

    def __init__(self, start: np.ndarray, kernel: np.ndarray, best: bool = False, norm_prior: bool = False):
        with np.errstate(divide="ignore"):
            self.log_start = np.maximum(np.log(start), LOG_FLOOR)
            self.logM = np.maximum(np.log(kernel), LOG_FLOOR)
        self.M = kernel
        self.best, self.norm_prior = best, norm_prior
        self.K = len(start)

    def forward(self, logb: np.ndarray, n: np.ndarray, entry: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Prior, posterior (B, N, K) and log increments (B, N); ``start`` rows begin a trajectory."""
        B, N, K = logb.shape
        prior, post, inc = np.zeros((B, N, K)), np.zeros((B, N, K)), np.zeros((B, N))
        prev = np.where(start[:, None], 0.0, entry)
        for i in range(N):
            p = _step(prev, self.M, self.logM, self.best)
            if self.norm_prior:
                p = _norm(p, self.best)[1]
            if i == 0:
                p = np.where(start[:, None], self.log_start, p)
            c, q = _norm(p + logb[:, i], self.best)
            live = (i < n)[:, None]
            prior[:, i], post[:, i], inc[:, i] = p, q, np.where(live[:, 0], c, 0.0)
            prev = np.where(live, q, prev)
        return prior, post, inc

    def backward(self, logb: np.ndarray, n: np.ndarray, exit_: np.ndarray, last: np.ndarray) -> np.ndarray:
        """(B, N, K) log weights of everything after each row; ``last`` rows end a trajectory."""
        B, N, K = logb.shape
        beta = np.zeros((B, N, K))
        end = np.where(last[:, None], 0.0, exit_)
        Mt, logMt = self.M.T, self.logM.T
        nxt = end
        for i in range(N - 1, -1, -1):
            final = (i == n - 1)[:, None]
            inner = (i < n - 1)[:, None]
            if i + 1 < N:
                b = _norm(_step(logb[:, i + 1] + nxt, Mt, logMt, self.best), self.best)[1]
            else:
                b = end
            nxt = np.where(final, end, np.where(inner, b, nxt))
            beta[:, i] = nxt
        return beta

    def block_matrix(self, logb: np.ndarray, n: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(B, K, K) action of each block; a first block ignores what enters it. NaN if a value is not finite."""
        B, N, K = logb.shape
        eye = np.where(np.eye(K) > 0, 0.0, LOG_FLOOR)
        mat = np.repeat(eye[None], B, axis=0)
        for i in range(N):
            stepped = _step(mat, self.M, self.logM, self.best)
            if i == 0:
                stepped = np.where(first[:, None, None], self.log_start[None, None, :], stepped)
            new = stepped + logb[:, i][:, None, :]
            new = new - new.max(axis=(1, 2), keepdims=True)  # a common factor does not matter
            mat = np.where((i < n)[:, None, None], new, mat)
        mat[~np.isfinite(logb).all(axis=(1, 2))] = np.nan
        return mat


def _through(v: np.ndarray, mat: np.ndarray, best: bool) -> np.ndarray:
    """Log vector through one block matrix (left to right)."""
    s = v[:, None] + mat
    m = s.max(axis=0)
    out = m if best else m + np.log(np.exp(s - m).sum(axis=0))
    return _norm(out[None], best)[1][0]


# batches of blocks ------------------------------------------------------------

def _pad(flat: list[np.ndarray], n: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(flat), int(n.max()), width))
    for i, f in enumerate(flat):
        out[i, : n[i]] = np.asarray(f, dtype=float).reshape(n[i], width)
    return out


def _log_emissions(part: pd.DataFrame, n: np.ndarray, K: int, emit: Emit | None) -> np.ndarray:
    """Padded (B, N, K) log-likelihoods, read from the row or computed from its features."""
    if emit is None:
        return _pad(list(part["logb"]), n, K)
    live = np.arange(int(n.max()))[None, :] < n[:, None]
    out = np.zeros((*live.shape, K))
    out[live] = emit(flat_features(part["x"], n))
    return out


def flat_features(col: pd.Series, n: np.ndarray) -> np.ndarray:
    """(rows, width) features of blocks of ``n`` rows, from arrays or from their bytes."""
    if isinstance(col.iloc[0], (bytes, bytearray, memoryview)):
        flat = np.frombuffer(b"".join(col))
    else:
        flat = np.concatenate([np.asarray(x, dtype=float) for x in col])
    return flat.reshape(int(n.sum()), -1)


def as_bytes(packed: DataFrame) -> DataFrame:
    """Packed rows with the numbers of ``x`` as bytes, which tables that many passes read hand to Python in one piece."""
    at, schema = packed.columns.index("x"), ", ".join(f"{c} {'binary' if c == 'x' else t}" for c, t in packed.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.asarray(x.values, dtype=float).tobytes() for x in batch.column(at)]
            cols = [pa.array(rows, pa.binary()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return packed.mapInArrow(run, schema)


def _vectors(col: pd.Series, K: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors (zeros where there is none), and where there is none."""
    none = col.isna().to_numpy()
    return np.array([np.zeros(K) if v is None else np.asarray(v, dtype=float) for v in col]).reshape(len(col), K), none


class Borders:
    """What enters blocks from the left and from the right, and which blocks belong to a bad trajectory."""

    def __init__(self, part: pd.DataFrame, logb: np.ndarray, K: int):
        self.entry, self.start = _vectors(part["entry"], K)
        self.exit, self.last = _vectors(part["exit"], K)
        self.bad = ~(np.isfinite(logb).all(axis=(1, 2)) & np.isfinite(self.entry).all(axis=1) & np.isfinite(self.exit).all(axis=1))
        self.entry[self.bad] = self.exit[self.bad] = 0.0


def chunks(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Blocks of similar length together, so padding stays small."""
    pdf = pdf.sort_values("n", kind="stable")
    for lo in range(0, len(pdf), CHUNK):
        yield pdf.iloc[lo : lo + CHUNK]


def pack(rows: DataFrame, block: int = BLOCK, count: int | None = None) -> DataFrame:
    """Rows (keys, t, and an array ``logb`` or ``x``) to one row per block with a flat array. Partitions follow the ``count`` of rows, if known."""
    col = "logb" if "logb" in rows.columns else "x"
    cut = spread(rows.withColumn("blk", F.floor(F.col("t") / block).cast("bigint")), [*KEYS, "blk"], count)
    packed = cut.groupBy(*KEYS, "blk").agg(F.array_sort(F.collect_list(F.struct("t", col))).alias("_r"))
    return packed.select(*KEYS, "blk", F.size("_r").alias("n"), F.flatten(F.col(f"_r.{col}")).alias(col))


_KEY_SCHEMA = ", ".join(f"{k} bigint" for k in KEYS)


def with_borders(packed: DataFrame, kernel: Kernel, longest: int, block: int = BLOCK, fan: int = BLOCK,
                 emit: Emit | None = None) -> DataFrame:
    """Add ``entry`` / ``exit`` vectors to every block (NULL at the ends of a trajectory)."""
    none = F.lit(None).cast("array<double>")
    if longest <= block:
        return packed.withColumns({"entry": none, "exit": none})
    K = kernel.K

    def reduce_blocks(it):
        for pdf in it:
            for part in chunks(pdf):
                n = part["n"].to_numpy()
                mats = kernel.block_matrix(_log_emissions(part, n, K, emit), n, part["blk"].to_numpy() == 0)
                yield part[[*KEYS, "blk"]].assign(mat=list(mats.reshape(len(part), -1)))

    long_only = packed.groupBy(*KEYS).agg(F.max("blk").alias("_m")).where("_m > 0").select(*KEYS)
    several = packed.join(long_only, KEYS, "left_semi")
    mats = several.mapInPandas(reduce_blocks, f"{_KEY_SCHEMA}, blk bigint, mat array<double>")
    borders = _walk(mats, kernel, -(-longest // block), fan)
    return packed.join(borders, [*KEYS, "blk"], "left")


def _walk(mats: DataFrame, kernel: Kernel, n_blocks: int, fan: int) -> DataFrame:
    """(keys, blk, entry, exit) from block matrices, level by level."""
    K, best = kernel.K, kernel.best
    out_schema = f"{_KEY_SCHEMA}, blk bigint, entry array<double>, exit array<double>"

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("blk")
        ms = [np.asarray(m, dtype=float).reshape(K, K) for m in pdf["mat"]]
        first_entry = pdf["entry"].iloc[0] if "entry" in pdf else None
        last_exit = pdf["exit"].iloc[-1] if "exit" in pdf else None
        entry, v = [], None if first_entry is None else np.asarray(first_entry, dtype=float)
        for m in ms:
            entry.append(v)
            v = _through(np.zeros(K) if v is None else v, m, best)
        exit_, w = [], None if last_exit is None else np.asarray(last_exit, dtype=float)
        for m in reversed(ms):
            exit_.append(w)
            w = _through(np.zeros(K) if w is None else w, m.T, best)
        res = pdf[[*KEYS, "blk"]].copy()
        res["entry"], res["exit"] = entry, exit_[::-1]
        return res

    if n_blocks <= fan:
        return mats.groupBy(*KEYS).applyInPandas(walk, out_schema)

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("blk")
        acc = None
        for m in pdf["mat"]:
            m = np.asarray(m, dtype=float).reshape(K, K)
            if acc is None:
                acc = m
            else:
                s = acc[:, :, None] + m[None, :, :]
                top = s.max(axis=1)
                acc = top if best else top + np.log(np.exp(s - top[:, None, :]).sum(axis=1))
                acc = acc - acc.max()
        res = pdf[[*KEYS, "grp"]].iloc[:1].rename(columns={"grp": "blk"})
        res["mat"] = [acc.reshape(-1)]
        return res

    grouped = mats.withColumn("grp", F.floor(F.col("blk") / fan).cast("bigint"))
    upper = grouped.groupBy(*KEYS, "grp").applyInPandas(compose, f"{_KEY_SCHEMA}, blk bigint, mat array<double>")
    borders = _walk(upper, kernel, -(-n_blocks // fan), fan).withColumnRenamed("blk", "grp")
    joined = grouped.join(borders, [*KEYS, "grp"])
    return joined.groupBy(*KEYS, "grp").applyInPandas(walk, out_schema)


def longest_sequence(rows: DataFrame) -> int:
    return sequence_sizes(rows)[0]


def sequence_sizes(rows: DataFrame) -> tuple[int, int]:
    """Length of the longest sequence, and rows of all."""
    top, n = rows.agg(F.max("t"), F.count(F.lit(1))).first()
    return int(top or 0) + 1, n


def run_blocks(rows: DataFrame, kernel: Kernel, fn: Callable, schema: str, longest: int | None = None,
               block: int = BLOCK, fan: int = BLOCK, emit: Emit | None = None) -> DataFrame:
    """Apply ``fn(part, logb, n, borders) -> DataFrame`` to chunks of blocks.

    ``rows`` carry finished log-likelihoods in ``logb``, or features in ``x``
    that ``emit`` turns into log-likelihoods inside the task. Blocks of bad
    trajectories arrive with ``borders.bad`` set and zeros for values.
    """
    count = None
    if longest is None:
        longest, count = sequence_sizes(rows)
    return run_packed(pack(rows, block, count), kernel, fn, schema, longest, block, fan, emit)


def run_packed(packed: DataFrame, kernel: Kernel, fn: Callable, schema: str, longest: int, block: int = BLOCK, fan: int = BLOCK,
               emit: Emit | None = None) -> DataFrame:
    """``run_blocks`` on rows that are packed already (a table that many passes read)."""
    bordered = with_borders(packed, kernel, longest, block, fan, emit)
    K = kernel.K

    def apply(it):
        for pdf in it:
            for part in chunks(pdf):
                n = part["n"].to_numpy()
                logb = _log_emissions(part, n, K, emit)
                borders = Borders(part, logb, K)
                yield fn(part, np.where(borders.bad[:, None, None], 0.0, logb), n, borders)

    return bordered.mapInPandas(apply, schema)


def _flat_rows(part: pd.DataFrame, n: np.ndarray, block: int, bad: np.ndarray, **cols: np.ndarray) -> pd.DataFrame:
    """(B, N, ...) results back to one row per window, without those of bad trajectories."""
    N = int(n.max())
    live = (np.arange(N)[None, :] < n[:, None]) & ~bad[:, None]
    out = {k: np.repeat(part[k].to_numpy(), np.where(bad, 0, n)) for k in KEYS}
    out["t"] = (part["blk"].to_numpy()[:, None] * block + np.arange(N)[None, :])[live]
    for name, v in cols.items():
        out[name] = list(v[live]) if v.ndim == 3 else v[live]
    return pd.DataFrame(out)


# jobs ---------------------------------------------------------------------------

def forward_filter(rows: DataFrame, start: np.ndarray, kernel: np.ndarray, longest: int | None = None,
                   block: int = BLOCK, fan: int = BLOCK, norm_prior: bool = True, emit: Emit | None = None,
                   keep_logb: bool = False) -> DataFrame:
    """Per window: log prior, log posterior belief and log p(o_t | past)."""
    k = Kernel(start, kernel, norm_prior=norm_prior)
    more = ", logb array<double>" if keep_logb else ""

    def fn(part, logb, n, b):
        prior, post, inc = k.forward(logb, n, b.entry, b.start)
        kept = {"logb": logb} if keep_logb else {}
        return _flat_rows(part, n, block, b.bad, prior=prior, post=post, ll=inc, **kept)

    schema = f"{_KEY_SCHEMA}, t bigint, prior array<double>, post array<double>, ll double{more}"
    return run_blocks(rows, k, fn, schema, longest, block, fan, emit)


def smooth(rows: DataFrame, start: np.ndarray, kernel: np.ndarray, longest: int | None = None,
           block: int = BLOCK, fan: int = BLOCK, emit: Emit | None = None) -> DataFrame:
    """Per window: posterior ``gamma`` given the whole trajectory and the forward log increment."""
    k = Kernel(start, kernel)

    def fn(part, logb, n, b):
        _, post, inc = k.forward(logb, n, b.entry, b.start)
        _, g = _norm(post + k.backward(logb, n, b.exit, b.last), False)
        return _flat_rows(part, n, block, b.bad, gamma=np.exp(g), ll=inc)

    return run_blocks(rows, k, fn, f"{_KEY_SCHEMA}, t bigint, gamma array<double>, ll double", longest, block, fan, emit)


def _back_pointers(k: Kernel, logb: np.ndarray, n: np.ndarray, b: Borders) -> tuple[np.ndarray, np.ndarray]:
    """Best predecessor of each state at each row (B, N, K), and the best last state of each block."""
    _, post, _ = k.forward(logb, n, b.entry, b.start)
    before = np.concatenate([b.entry[:, None], post[:, :-1]], axis=1)
    back = (before[..., :, None] + k.logM).argmax(axis=-2)
    return back, post[np.arange(len(n)), n - 1].argmax(axis=1)


def _follow(back: np.ndarray, n: np.ndarray, state: np.ndarray) -> np.ndarray:
    """States (B, N) of the paths that end in ``state``, and before the first row, in column 0 of (B, N + 1)."""
    B, N, _ = back.shape
    path, rows = np.zeros((B, N + 1), dtype=np.int64), np.arange(B)
    for i in range(N - 1, -1, -1):
        state_here = np.where(i < n, state, 0)
        path[:, i + 1] = state_here
        state = np.where(i < n, back[rows, i, state_here], state)
    path[:, 0] = state
    return path


def _exit_states(maps: DataFrame, n_blocks: int, fan: int) -> DataFrame:
    """(keys, blk, state): the best path's state at the end of each block, from (keys, blk, lead, best, given).

    ``lead[z]`` is the state before the block if the block ends in z. The last block ends in its
    ``best`` state, or in ``given``. Many blocks are composed and walked level by level.
    """
    schema = f"{_KEY_SCHEMA}, blk bigint, state int"

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("blk", ascending=False)
        given = pdf["given"].iloc[0]
        state = int(pdf["best"].iloc[0] if pd.isna(given) else given)
        out = []
        for lead in pdf["lead"]:
            out.append(state)
            state = int(lead[state])
        return pdf[[*KEYS, "blk"]].assign(state=out)

    if n_blocks <= fan:
        return maps.groupBy(*KEYS).applyInPandas(walk, schema)

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("blk", ascending=False)
        lead = np.arange(len(pdf["lead"].iloc[0]))
        for m in pdf["lead"]:
            lead = np.asarray(m)[lead]
        res = pdf[[*KEYS, "grp", "best"]].iloc[:1].rename(columns={"grp": "blk"})
        return res.assign(lead=[lead.tolist()], given=None)[[*KEYS, "blk", "lead", "best", "given"]]

    grouped = maps.withColumn("grp", F.floor(F.col("blk") / fan).cast("bigint"))
    upper = grouped.groupBy(*KEYS, "grp").applyInPandas(compose, f"{_KEY_SCHEMA}, blk bigint, lead array<int>, best int, given int")
    ends = _exit_states(upper, -(-n_blocks // fan), fan).select(*KEYS, F.col("blk").alias("grp"), F.col("state").alias("_end"))
    dealt = grouped.join(ends, [*KEYS, "grp"]).withColumn("given", F.col("_end").cast("int")).drop("_end")
    return dealt.groupBy(*KEYS, "grp").applyInPandas(walk, schema)


def best_path(rows: DataFrame, start: np.ndarray, kernel: np.ndarray, longest: int | None = None,
              block: int = BLOCK, fan: int = BLOCK, emit: Emit | None = None) -> DataFrame:
    """Most likely state sequence of each trajectory, one path by back-pointers also where several are equally good."""
    k = Kernel(start, kernel, best=True)
    count = None
    if longest is None:
        longest, count = sequence_sizes(rows)
    schema = f"{_KEY_SCHEMA}, t bigint, z int"
    packed = pack(rows, block, count)
    if longest <= block:
        def whole(part, logb, n, b):
            back, best = _back_pointers(k, logb, n, b)
            return _flat_rows(part, n, block, b.bad, z=_follow(back, n, best)[:, 1:].astype("int32"))

        return run_packed(packed, k, whole, schema, longest, block, fan, emit)

    def leads(part, logb, n, b):
        back, best = _back_pointers(k, logb, n, b)
        lead = np.stack([_follow(back, n, np.full(len(n), z))[:, 0] for z in range(k.K)], axis=1).astype("int32")
        return part[[*KEYS, "blk"]].assign(lead=list(lead), best=best.astype("int32"), given=None)

    maps = run_packed(packed, k, leads, f"{_KEY_SCHEMA}, blk bigint, lead array<int>, best int, given int", longest, block, fan, emit)
    ends = _exit_states(maps, -(-longest // block), fan)

    def trace(part, logb, n, b):
        back, _ = _back_pointers(k, logb, n, b)
        return _flat_rows(part, n, block, b.bad, z=_follow(back, n, part["state"].to_numpy().astype(np.int64))[:, 1:].astype("int32"))

    return run_packed(packed.join(ends, [*KEYS, "blk"]), k, trace, schema, longest, block, fan, emit)


def pair_sums(k: Kernel, logb: np.ndarray, n: np.ndarray, b: Borders, weight: np.ndarray | None = None):
    """gamma (B, N, K), increments (B, N), and the sum (K, K) of the posteriors of the steps into all rows, each times its ``weight`` (B, N).

    A step's posterior is an outer product times the kernel, so the sum is one matrix product. Steps that underflow are added up in logs.
    """
    _, post, inc = k.forward(logb, n, b.entry, b.start)
    beta = k.backward(logb, n, b.exit, b.last)
    gamma = np.exp(_norm(post + beta, False)[1])
    prev = np.concatenate([b.entry[:, None], post[:, :-1]], axis=1)
    live = np.arange(logb.shape[1])[None, :] < n[:, None]
    step = live & ~b.bad[:, None]
    step[:, 0] &= ~b.start
    u, v = prev[step], (logb + beta)[step]
    w = np.ones(len(u)) if weight is None else weight[step]
    eu, ev = np.exp(u - u.max(axis=1, keepdims=True)), np.exp(v - v.max(axis=1, keepdims=True))
    c = ((eu @ k.M) * ev).sum(axis=1)
    faint = c < 1e-200
    xi = k.M * ((eu * (np.where(faint, 0.0, w) / np.where(faint, 1.0, c))[:, None]).T @ ev)
    if faint.any():
        s = u[faint][:, :, None] + k.logM + v[faint][:, None, :]
        s = np.exp(s - s.max(axis=(1, 2), keepdims=True))
        xi = xi + (s * (w[faint] / s.sum(axis=(1, 2)))[:, None, None]).sum(axis=0)
    return gamma * live[..., None], inc, xi
