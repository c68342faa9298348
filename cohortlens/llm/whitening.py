"""Embedding whitening through the exact characteristic polynomial of an integer scatter.

1. Every entry c becomes floor(scale * c); per task the products of all dimension
   pairs are summed exactly, and Spark adds the tasks' sums as limbs of 40 bits.
   A = n * sum(x x') - S S' is an integer matrix, n^2 times the covariance.
2. Its characteristic polynomial is found modulo many primes of 31 bits, one row a
   prime: Hessenberg reduction by similarity transforms and the recurrence of a
   Hessenberg determinant.  Chinese remaindering gives the integer coefficients;
   the number of primes follows from a bound on them (Maclaurin's inequality).
3. All roots are real, so Descartes' rule on the polynomial moved to a point counts
   the roots above it exactly.  Bisection with that count isolates the largest
   roots, bisection on exact signs refines them far beyond double precision;
   powers of x dividing the polynomial are the null space, known exactly.
4. One row a root (or a bundle of roots that no double could tell apart): inverse
   iteration on A - root in decimals whose precision follows from the gaps gives
   the unit eigenvectors.
5. Rows are centred in integers and projected; the covariance of the written result
   is measured in another pass.

What reaches the driver depends on the number of dimensions alone.  Components with
eigenvalue 0 cannot be whitened and have no rows.

Edge cases: null vectors and vectors holding null or non-finite entries take no
part, nor do vectors whose length is not the most frequent one (ties: the longer)
or 0; null ids and repeated rows stay, each a row; equal eigenvalues give an
orthonormal basis of their space; entries beyond 2^61 after scaling count as that;
one row or equal rows have no components, an empty table gives an empty result;
extra columns are not used.
"""

from __future__ import annotations

import math
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import common

LIMB = 40
CAP = float(1 << 61)
CLOSE = 80  # roots closer than 2^-CLOSE of the largest one are a bundle


def integer_rows(column: pa.ListArray, scale: int) -> np.ndarray:
    """floor(scale * c) of a batch of vectors of one length."""
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * v), -CAP, CAP).astype(np.int64)


def exact_gram(y: np.ndarray) -> np.ndarray:
    """y' y as Python integers; by doubles while every partial sum is exact in them."""
    if float(np.abs(y).max(initial=0)) ** 2 * len(y) < 2 ** 53:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    high, low = y >> 20, y & ((1 << 20) - 1)
    mixed = _product(high, low)
    return exact_gram(low) + (mixed + mixed.T) * (1 << 20) + exact_gram(high) * (1 << 40)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * len(a) < 2 ** 53:
        return (a.astype(np.float64).T @ b.astype(np.float64)).astype(np.int64).astype(object)
    return _product(a >> 20, b) * (1 << 20) + _product(a & ((1 << 20) - 1), b)


def limbs(values: list, names: tuple) -> pa.RecordBatch:
    """(i, j, limb, v) rows of exact integers: v in [0, 2^LIMB), the last limb signed."""
    rows = []
    for i, j, x in values:
        x, k = int(x), 0
        while not -(1 << LIMB) < x < 1 << LIMB:
            rows.append((i, j, k, x & ((1 << LIMB) - 1)))
            x, k = x >> LIMB, k + 1
        rows.append((i, j, k, x))
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], names=list(names))


def moments(vectors: DataFrame, scale: int) -> tuple[int, list, list]:
    """(n, sums, products) of the integer vectors of column v: exact at any size."""

    def add(batches):
        n, total, gram = 0, 0, 0
        for batch in batches:
            for a in range(0, len(batch), 4096):
                part = batch.column(0).slice(a, 4096)
                y = integer_rows(part, scale)
                n += len(y)
                total = total + y.astype(object).sum(axis=0) if len(y) else total
                gram = gram + exact_gram(y) if len(y) else gram
        if n:
            d = len(total)
            yield limbs([(-1, -1, n)] + [(-1, i, total[i]) for i in range(d)]
                        + [(i, j, gram[i, j]) for i in range(d) for j in range(i, d)], ("i", "j", "limb", "v"))

    rows = (vectors.select("v").mapInArrow(add, "i long, j long, limb long, v long")
            .groupBy("i", "j", "limb").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect())
    found: dict = {}
    for r in rows:
        at = (r["i"], r["j"])
        found[at] = found.get(at, 0) + (int(r["v"]) << (LIMB * r["limb"]))
    d = sum(1 for i, j in found if i == -1 and j >= 0)
    gram = [[found[min(i, j), max(i, j)] for j in range(d)] for i in range(d)]
    return found.get((-1, -1), 0), [found[-1, i] for i in range(d)], gram


def is_prime(p: int) -> bool:
    """Miller-Rabin with bases that decide all numbers below 2^32."""
    d, s = p - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in (2, 7, 61):
        x = pow(a, d, p)
        if x not in (1, p - 1) and all((x := x * x % p) != p - 1 for _ in range(s - 1)):
            return False
    return True


def primes_above(bits: float) -> list[int]:
    """Primes below 2^31, from the top, whose product has more than ``bits`` bits."""
    out, p, have = [], (1 << 31) - 1, 0.0
    while have <= bits:
        if is_prime(p):
            out.append(p)
            have += math.log2(p)
        p -= 2
    return out


def polynomial_modulo(a: np.ndarray, p: int) -> list[int]:
    """Coefficients (constant first) of det(x - a) modulo p, by Hessenberg reduction; a has entries in [0, p)."""
    h, d = a.copy(), len(a)
    for j in range(d - 2):
        rows = np.flatnonzero(h[j + 1:, j])
        if not len(rows):
            continue
        r = j + 1 + int(rows[0])
        if r != j + 1:
            h[[j + 1, r]] = h[[r, j + 1]]
            h[:, [j + 1, r]] = h[:, [r, j + 1]]
        u = h[j + 2:, j] * pow(int(h[j + 1, j]), -1, p) % p
        h[j + 2:] = (h[j + 2:] - u[:, None] * h[j + 1][None] % p) % p
        h[:, j + 1] = (h[:, j + 1] + (h[:, j + 2:] * u % p).sum(axis=1)) % p
    polys = np.zeros((d + 1, d + 1), dtype=np.int64)
    polys[0, 0] = 1
    for k in range(1, d + 1):
        polys[k, 1:] = polys[k - 1, :-1]
        weight, product = np.zeros(k, dtype=np.int64), 1
        for i in range(k - 1, -1, -1):  # column k, row i, times the subdiagonal between them
            weight[i] = int(h[i, k - 1]) * product % p
            product = product * int(h[i, i - 1]) % p if i else 0
        polys[k] = (polys[k] - (polys[:k] * weight[:, None] % p).sum(axis=0)) % p
    return polys[d].tolist()


def characteristic_polynomial(spark: SparkSession, a: list) -> list[int]:
    """Integer coefficients (constant first) of det(x - a) for a positive semidefinite integer matrix."""
    d, trace = len(a), sum(a[i][i] for i in range(len(a)))
    mean = max(1.0, math.log2(max(1, trace)) - math.log2(d) + 1e-6)
    # the k-th symmetric function of roots of mean m is at most C(d, k) m^k; one bit more for the sign
    primes = primes_above(d * mean + d + 2)

    def reduce(batches):
        for batch in batches:
            ps = batch.column(0).to_pylist()
            out = [polynomial_modulo(np.array([[x % p for x in row] for row in a], dtype=np.int64), p) for p in ps]
            yield pa.RecordBatch.from_arrays([pa.array(ps, pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["p", "c"])

    rows = (spark.createDataFrame([(p,) for p in primes], "p long").repartition(min(len(primes), 32), "p")
            .mapInArrow(reduce, "p long, c array<long>").collect())
    product = math.prod(primes)
    weights = {p: product // p * pow(product // p % p, -1, p) for p in primes}
    out = [sum(r["c"][k] * weights[r["p"]] for r in rows) % product for k in range(d + 1)]
    return [c - product if c > product // 2 else c for c in out]


def scaled(poly: list[int], s: int) -> list[int]:
    """Integer polynomial with every root times 2^s."""
    d = len(poly) - 1
    return [c << (s * (d - i)) for i, c in enumerate(poly)]


def roots_above(poly: list[int], at: int) -> int:
    """Number of roots over ``at`` of a polynomial with real roots only: sign changes after moving it there."""
    c = list(poly)
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += at * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def value(poly: list[int], at: int) -> int:
    out = 0
    for c in reversed(poly):
        out = out * at + c
    return out


def largest_roots(poly: list[int], k: int, bits: int = 256) -> tuple[list[tuple[int, int, int]], int]:
    """([(lower, upper, count)], s): disjoint intervals holding the largest positive roots times 2^s.

    At least k roots (all, if fewer), largest first; each interval holds one root, or
    several that differ by less than 2^-bits of the largest; it is that narrow.
    """
    while len(poly) > 1 and poly[0] == 0:
        poly = poly[1:]
    d = len(poly) - 1
    if not d:
        return [], 0
    s = 8
    while True:  # room for the wanted precision below the largest root
        p = scaled(poly, s)
        top = 1
        while roots_above(p, top):
            top *= 2
        need = bits + 8 - top.bit_length()
        if need <= 0:
            break
        s += need
    width, todo, found = max(1, top >> (bits + 2)), [(0, top, d, 0)], []
    while todo and sum(c for _, _, c in found) < k:
        low, high, count, over = todo.pop()  # count roots in (low, high], ``over`` above them
        if count == 1 or high - low <= width:
            found.append((low, high, count))
            continue
        middle = (low + high) // 2
        above = roots_above(p, middle) - over
        if count - above:
            todo.append((low, middle, count - above, over + above))
        if above:
            todo.append((middle, high, above, over))
    narrow = []
    for low, high, count in found:
        if count == 1:  # simple: p changes its sign between low (excluded) and high (included)
            right = value(p, high)
            if right == 0:
                low = high - 1
            while high - low > width:
                middle = (low + high) // 2
                at = value(p, middle)
                if at == 0:
                    low, high = middle - 1, middle
                elif (at > 0) == (right > 0):
                    high = middle
                else:
                    low = middle
        narrow.append((low, high, count))
    return narrow, s


def bundles(roots: list, bits: int = CLOSE) -> list[list]:
    """Intervals, largest first, joined where the gap is below 2^-bits of the largest root."""
    out: list = []
    for r in roots:
        if out and (out[-1][-1][0] - r[1]) << bits < roots[0][1]:
            out[-1].append(r)
        else:
            out.append([r])
    return out


def null_space(a: list, root: Decimal, count: int, digits: int, rounds: int = 3) -> list[list[float]]:
    """``count`` orthonormal vectors of (a - root)'s near-null space by inverse iteration in decimals."""
    d = len(a)
    with localcontext() as ctx:
        ctx.prec = digits
        m = [[Decimal(x) for x in row] for row in a]
        for i in range(d):
            m[i][i] -= root
        tiny = sum(abs(m[i][i]) + Decimal(a[i][i]) for i in range(d)) * Decimal(10) ** (-digits) + Decimal(10) ** -digits
        order = list(range(d))
        for j in range(d):  # LU with row exchanges
            best = max(range(j, d), key=lambda i: abs(m[i][j]))
            m[j], m[best] = m[best], m[j]
            order[j], order[best] = order[best], order[j]
            if abs(m[j][j]) < tiny:
                m[j][j] = tiny
            row, inv = m[j], 1 / m[j][j]
            for i in range(j + 1, d):
                own = m[i]
                if own[j]:
                    own[j] = u = own[j] * inv
                    for c in range(j + 1, d):
                        own[c] -= u * row[c]
        rng = np.random.default_rng(11)
        vectors = [[Decimal(float(x)) for x in rng.standard_normal(d)] for _ in range(count)]
        for _ in range(rounds):
            solved: list = []
            for v in vectors:
                y = [v[i] for i in order]
                for i in range(d):
                    y[i] -= sum(m[i][c] * y[c] for c in range(i))
                for i in range(d - 1, -1, -1):
                    y[i] = (y[i] - sum(m[i][c] * y[c] for c in range(i + 1, d))) / m[i][i]
                for _ in range(2):
                    big = max(abs(x) for x in y)
                    y = [x / big for x in y]
                    for w in solved:
                        dot = sum(x * z for x, z in zip(y, w))
                        y = [x - dot * z for x, z in zip(y, w)]
                size = sum(x * x for x in y).sqrt()
                solved.append([x / size for x in y])
            vectors = solved
        return [[float(x) for x in v] for v in vectors]


def components(spark: SparkSession, a: list, k: int) -> list[tuple[Decimal, list[float]]]:
    """The k largest positive (eigenvalue, unit eigenvector) of a positive semidefinite integer matrix."""
    roots, s = largest_roots(characteristic_polynomial(spark, a), k)
    work = []
    for i, group in enumerate(bundles(roots)):
        low, high, count = group[-1][0], group[0][1], sum(c for _, _, c in group)
        work.append((i, str(low), str(high), count))
    if not work:
        return []

    def solve(batches):
        for batch in batches:
            for i, low, high, count in zip(*(c.to_pylist() for c in batch.columns)):
                digits = 60 + len(high)
                with localcontext() as ctx:
                    ctx.prec = digits
                    root = (Decimal(low) + Decimal(high)) / 2 / (1 << s)
                out = null_space(a, root, count, digits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * count, pa.int64()), pa.array([str(root)] * count, pa.string()),
                     pa.array(out, pa.list_(pa.float64()))], names=["i", "root", "u"])

    # one row a bundle, spread evenly: a solve takes far longer than its row
    rows = (spark.createDataFrame(work, "i long, low string, high string, count long").repartition(min(len(work), 32), "i")
            .mapInArrow(solve, "i long, root string, u array<double>").collect())
    return [(Decimal(r["root"]), r["u"]) for r in sorted(rows, key=lambda r: r["i"])][:k]


def clean(df: DataFrame, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>): vectors of finite entries and of the most frequent length."""
    out = df.select(F.col(id_col).alias("vec_id"), F.col(vec).cast("array<double>").alias("v")).where(
        F.col("v").isNotNull() & (F.size("v") > 0)).where(
        F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))
    size = out.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return out.where(F.size("v") == (size[0]["d"] if size else 0))


def whiten(vectors: DataFrame, k: int = 32, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """(vec_id, component, n, deviation decimal, whitened, explained, identity_error) per row and component.

    ``vectors``: (vec_id, v array<double>) of one length.  ``offset`` is added to
    every integer entry; it cancels in all that is returned.
    """
    spark = vectors.sparkSession
    vectors = common.materialize(vectors, "vectors")
    n, total, gram = moments(vectors, scale)
    d = len(total)
    total = [t + n * offset for t in total]
    a = [[n * gram[i][j] - (total[i] - n * offset) * (total[j] - n * offset) for j in range(d)] for i in range(d)]
    trace = sum(a[i][i] for i in range(d))
    found = components(spark, a, k) if trace else []
    # an eigenvalue of the covariance is root / n^2; doubles hold what is left of it
    scales = [float((e / (n * n)).sqrt()) for e, _ in found]
    explained = [float(e / trace) for e, _ in found]
    basis = np.array([u for _, u in found], dtype=np.float64).reshape(len(found), d)
    id_type = vectors.schema["vec_id"].dataType.simpleString()

    def project(batches):
        sums = np.array(total, dtype=object)
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                y = integer_rows(part.column(1), scale)
                if n * (float(np.abs(y).max(initial=0)) + offset) < 2 ** 62:
                    c = n * (y + offset) - np.array(total, dtype=np.int64)
                    small = d * float(np.abs(c).max(initial=0)) ** 2 < 2 ** 62
                    dev = (c * c).sum(axis=1).tolist() if small else (c.astype(object) ** 2).sum(axis=1).tolist()
                else:
                    c = n * (y.astype(object) + offset) - sums
                    dev = (c ** 2).sum(axis=1).tolist()
                w = (c / n).astype(np.float64) @ basis.T / np.array(scales)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([str(x) for x in dev], pa.string()),
                     pa.array(list(w), pa.list_(pa.float64()))], names=["vec_id", "deviation", "w"])

    if not found:
        return spark.createDataFrame([], f"vec_id {id_type}, component int, n long, deviation decimal(38,0), "
                                         "whitened double, explained double, identity_error double")
    done = common.materialize(vectors.mapInArrow(project, f"vec_id {id_type}, deviation string, w array<double>"), "whitened")
    error = identity_error(done, n, len(found))
    shares = F.array(*[F.lit(x) for x in explained])
    return (done.select("vec_id", F.col("deviation").try_cast("decimal(38,0)").alias("deviation"),
                        F.posexplode("w").alias("at", "whitened"))
            .select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
                    "whitened", F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error")))


def identity_error(done: DataFrame, n: int, k: int) -> float:
    """Largest absolute entry of the covariance of column w, minus the identity."""

    def add(batches):
        total, gram, seen = np.zeros(k), np.zeros((k, k)), False
        for batch in batches:
            w = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            total, gram, seen = total + w.sum(axis=0), gram + w.T @ w, seen or len(w) > 0
        if seen:
            i, j = np.triu_indices(k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.full(k, -1), i])), pa.array(np.concatenate([np.arange(k), j])),
                 pa.array(np.concatenate([total, gram[i, j]]))], names=["i", "j", "v"])

    sums = {(r["i"], r["j"]): r["v"] for r in done.select("w").mapInArrow(add, "i long, j long, v double")
            .groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}
    return max(abs(sums[i, j] / n - sums[-1, i] / n * sums[-1, j] / n - (i == j)) for i in range(k) for j in range(i, k))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whiten(clean(common.embeddings(spark, sf_dir)))
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))
