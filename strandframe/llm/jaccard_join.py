"""N-gram Jaccard join of documents: size-aware, heavy-light, exact.

Sets are the distinct 64-bit hashes of word shingles. Equal sets are one class from the start: a set's id is a 64-bit
hash, which is checked by a second one and by the size; ids on which different sets meet are replaced. Inverted
lists are built by a shuffle of sorted token blocks, by which every token learns in how many sets it is (df). Buckets of
tokens follow the counted tokens (``BUCKET`` each), in two shuffles where one would send too short blocks.
Under the global order (df, token) two sets of sizes s and r that link share a token among the first
``s - ceil(3s/4) + 1`` tokens of each; tokens of df 1 come first and cannot be shared, so most documents end there.

*Light* sets (size up to a boundary) enumerate all fixed-size subsets (pairs) of a prefix one longer, and
meet on equal pairs; *heavy* sets, and light ones that a heavy set's size range reaches, scan the inverted
lists of their prefix tokens. The boundary is the size up to which enumerating costs no more than scanning,
by the measured mean list length with each list counted as at most ``SCAN`` rows. That holds the boundary to 27 shingles
at most, which bounds what is enumerated: on long lists most sets are heavy. Results do not depend on it.

A first round contracts groups: sets that agree in a min-hash of their shared tokens are checked against the one
among them with the fewest tokens of its own, so m near copies cost m checks, not m^2, and linked sets become
one component. The complete round then looks only at lists that still hold several components and checks
every pair of such a list whose components differ, so no link between components is lost. Checks count the
shared tokens of both sets. In the join a token is the upper 48 bits of its hash. Tokens that a sample of sets shows in over
a share ``HOT`` of all, or in over ``BUCKET`` sets, are ordered last and are not gathered by token; their number is bounded
by the mean set size over that share. The sample grows as the share shrinks. Long lists are dealt over salts.

The components need no links inside a group; ``link_pairs`` and ``link_counts`` run the complete round on all
distinct sets without contraction and give every link.

Nulls and edges: null or empty text has an empty set, linked with nothing; fewer words than a shingle make one
shingle; rows of one doc_id each have a set; a null doc_id links like any but is never the
smallest (a component of null ids only has a null id). Empty table: empty result. Extra columns are ignored or kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, attach_by_key, components, shuffle_parts

WORDS = 5
#: Share of all sets over which a token counts as hot, and the least sample of sets that tells.
HOT, SAMPLE = 0.02, 4000
#: Tokens of a bucket; blocks of a group of documents beyond which tokens are dealt in two shuffles.
BUCKET, BLOCKS = 1 << 21, 4096
#: Members of an inverted list that one salt takes.
LIST = 4096
#: Bytes of text hashed at a time, tokens sent in one group of blocks.
CHUNK, GROUP = 1 << 20, 1 << 20
#: Min-hashes by which sets meet in the contracting round; most that a list entry counts in the cost of scanning.
MIN_HASHES = 3
SCAN = 4

_RNG = np.random.default_rng(20_240_607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MUL = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POW = np.cumprod(np.full(CHUNK + 1, _ODD, np.uint64)) * _INV
_IPOW = np.cumprod(np.full(CHUNK + 1, _INV, np.uint64)) * _ODD
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hash(word: bytes) -> np.ndarray:
    """Hash of one lowered word of any length: the polynomial in its bytes, piece by piece."""
    total, at = np.zeros(1, np.uint64), 0
    while at < len(word):
        b = np.frombuffer(word, np.uint8, min(CHUNK, len(word) - at), at)
        total += (_BYTE[b] * _POW[: len(b)]).sum(dtype=np.uint64) * np.array([pow(int(_ODD), at, 1 << 64)], np.uint64)
        at += len(b)
    return _mix(total + np.uint64(len(word)))


def _word_hashes(raw: bytes) -> np.ndarray:
    """Hashes of the words of a text (A-Z lowered), by prefix sums of a polynomial in the bytes."""
    out, at, n = [], 0, len(raw)
    lowered = raw.lower()  # of bytes: A-Z only
    spaces = (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")
    while at < n:
        end = min(n, at + CHUNK)
        if end < n:  # back to white space; a longer word is hashed by itself, to the same value
            cut = max(lowered.rfind(c, at, end) for c in spaces)
            if cut < at:
                end = min((k for k in (lowered.find(c, end) for c in spaces) if k >= 0), default=n)
                out.append(_word_hash(lowered[at:end]))
                at = end
                continue
            end = cut + 1
        b = np.frombuffer(lowered, np.uint8, end - at, at)
        space = _SPACE[b]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
        starts, ends = edge[0::2], edge[1::2]
        if len(starts):
            sums = np.zeros(len(b) + 1, np.uint64)
            np.cumsum(_BYTE[b] * _POW[: len(b)], out=sums[1:])
            out.append(_mix((sums[ends] - sums[starts]) * _IPOW[starts] + (ends - starts).astype(np.uint64)))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    w = _word_hashes((text or "").encode("utf-8", "surrogatepass"))
    if not len(w):
        return w
    if len(w) < words:
        return _mix(np.array([(w * _MUL[: len(w)]).sum() + np.uint64(len(w))], np.uint64))
    h = np.zeros(len(w) - words + 1, np.uint64)
    for k in range(words):
        h += w[k : len(w) - words + 1 + k] * _MUL[k]
    return np.unique(_mix(h))


def set_key(tokens: np.ndarray, clash: frozenset = frozenset()) -> int:
    """64-bit key of a set, signed; another one if its key is among those on which different sets met."""
    raw = tokens.tobytes()
    key = xxhash.xxh3_64_intdigest(raw) - (1 << 63)
    return key if key not in clash else xxhash.xxh3_64_intdigest(raw, 1) - (1 << 63)


def set_check(tokens: np.ndarray) -> int:
    """A second hash of a set, to verify that equal keys are equal sets."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes(), 2) - (1 << 63)


def need(s: int, r: int) -> int:
    """Least intersection of linked sets of sizes s and r: 100 i >= 75 (s + r - i)."""
    return -(-3 * (s + r) // 7)


def prefix_len(s):
    """Tokens of a set one of which any linked set shares."""
    return s - (3 * s + 3) // 4 + 1


def _pack(ids: np.ndarray) -> bytes:
    """Sorted 48-bit ids as compressed differences."""
    d = np.diff(ids, prepend=ids.dtype.type(0))
    return pa.compress(np.ascontiguousarray(d.view(np.uint8).reshape(len(d), 8)[:, :6].T), "zstd", asbytes=True) if len(d) else b""


def _unpack(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :6] = np.frombuffer(pa.decompress(data, 6 * n, "zstd", asbytes=True), np.uint8).reshape(6, n).T
    return np.cumsum(wide.view(np.uint64).ravel())


def _six(ids: np.ndarray) -> bytes:
    """48-bit ids in six bytes each."""
    return ids.view(np.uint8).reshape(len(ids), 8)[:, :6].tobytes()


def _from_six(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view(np.uint64).ravel()


def tokens_of(shingles: np.ndarray) -> np.ndarray:
    """Join tokens of a set: the upper 48 bits, sorted."""
    return shingles >> np.uint64(16)


def _set_rows(docs: DataFrame, words: int, clash: frozenset) -> DataFrame:
    def run(batches):
        for b in batches:
            sets = [shingle_set(t, words) for t in b.column(1).to_pylist()]
            cols = [[len(s) for s in sets], *([f(s) if len(s) else None for s in sets] for f in (lambda s: set_key(s, clash), set_check))]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", "n_shingles", "set_id", "check"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_id long, check long")


def document_sets(docs: DataFrame, scratch: Scratch, words: int = WORDS) -> tuple[DataFrame, frozenset]:
    """(doc_id, n_shingles, set_id) of every row, set_id null for an empty set; and the keys on which different sets met.

    Two of n sets meet with a chance of n^2 / 2^65, so these are few however many sets there are."""
    sets = scratch.store(_set_rows(docs, words, frozenset()), "sets")
    per = sets.where("set_id is not null").groupBy("set_id").agg(*[f(c).alias(f"{c}_{k}") for c in ("check", "n_shingles") for k, f in (("low", F.min), ("high", F.max))])
    clash = frozenset(r[0] for r in per.where("check_low <> check_high or n_shingles_low <> n_shingles_high").select("set_id").collect())
    if clash:
        sets = scratch.store(_set_rows(docs, words, clash), "sets1")
    return sets.drop("check"), clash


def _hot_tokens(docs: DataFrame, n_docs: int, words: int) -> np.ndarray:
    """Tokens in over a share of the sampled rows; at most (mean set size)/share of them."""
    if n_docs < SAMPLE // 2:  # no list is long
        return np.zeros(0, np.uint64)
    share = min(HOT, BUCKET / n_docs)
    step = max(1, n_docs // max(SAMPLE, int(40 / share)))
    some = docs.select("text").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(step)) == 0)

    def run(batches):
        for b in batches:
            for t in b.column(0).to_pylist():
                s = tokens_of(shingle_set(t, words))
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], ["t"])

    rows = some.mapInArrow(run, "t long").groupBy("t").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > share * max(1, n_docs // step))
    return np.sort(np.array([r[0] for r in rows.select("t").collect()], np.int64).view(np.uint64))


_ROUTED = "bucket int, n int, tokens binary, who binary, sets binary"


def _blocks_of(tokens: np.ndarray, who: np.ndarray, keys: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    """One row a bucket of (token, set ``keys[who]``) entries: sorted tokens, and the place of each one's set in ``sets``."""
    order = np.lexsort([tokens, bucket])
    tokens, who, bucket = tokens[order], who[order], bucket[order]
    cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
    out = []
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own, place = np.unique(who[lo:hi], return_inverse=True)
        packed = pa.compress(place.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)
        out.append((int(bucket[lo]), hi - lo, _pack(tokens[lo:hi]), packed, keys[own].tobytes()))
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    columns = zip(*out, strict=True) if out else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["bucket", "n", "tokens", "who", "sets"])


def _entries(row) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, sets) of a row of ``_blocks_of``."""
    n, t, w, keys = row
    place = np.frombuffer(pa.decompress(w, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n).T.copy().view(np.uint32).ravel()
    return _unpack(t, n), np.frombuffer(keys, np.int64)[place]


def _routes(buckets: int, hot: np.ndarray, words: int, clash: frozenset):
    """Kernel: tokens of groups of documents as one row a bucket."""

    def run(batches):
        held, total, seen = [], 0, set()

        def flush():
            tokens = np.concatenate([s for _, s in held])
            who = np.repeat(np.arange(len(held), dtype=np.uint32), [len(s) for _, s in held])
            keys = np.array([k for k, _ in held], np.int64)
            held.clear()
            return _blocks_of(tokens, who, keys, (tokens % np.uint64(buckets)).astype(np.int32))

        for b in batches:
            for text in b.column(0).to_pylist():
                s = shingle_set(text, words)
                if len(s) < 3:
                    continue  # sets of one or two only link with equal ones
                key = set_key(s, clash)
                if key in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(key)
                s = tokens_of(s)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                    s = s[hot[at] != s]
                if len(s):
                    held.append((key, s))
                    total += len(s)
                if total >= GROUP:
                    yield flush()
                    total = 0
        if held:
            yield flush()

    return run


def _split(coarse: int, fine: int):
    """Kernel over coarse buckets (token mod ``coarse``): their rows dealt to ``fine`` buckets each."""

    def run(batches):
        held, total, last = [], 0, None

        def flush():
            tokens, sets = (np.concatenate(x) for x in zip(*map(_entries, held), strict=True))
            keys, who = np.unique(sets, return_inverse=True)
            part = (tokens // np.uint64(coarse)) % np.uint64(fine)
            held.clear()
            return _blocks_of(tokens, who.astype(np.uint32), keys, last + coarse * part.astype(np.int32))

        for b in batches:
            for k, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (k != last or total >= GROUP):
                    yield flush()
                    total = 0
                last = k
                held.append(row)
                total += row[0]
        if held:
            yield flush()

    return run


#: What comes back to the groups of sets: kind 0 shared tokens with their df, 1 sizes (in counts), 2 hot tokens.
_BACK = "g int, kind byte, sets binary, counts binary, tokens binary, df binary"


def _group_of(ids: np.ndarray, groups: int) -> np.ndarray:
    return (_mix(ids.view(np.uint64)) % np.uint64(groups)).astype(np.int32)


def _back(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    kinds = [pa.int32(), pa.int8(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["g", "kind", "sets", "counts", "tokens", "df"])


def _by_group(sets: np.ndarray, tokens: np.ndarray, df: np.ndarray, groups: int, kind: int) -> list[tuple]:
    """One row per group of (set, token, df) triples: distinct sets, their numbers of tokens, tokens and dfs in that order."""
    g = _group_of(sets, groups)
    order = np.lexsort([tokens, sets, g])
    sets, tokens, df, g = sets[order], tokens[order], df[order], g[order]
    out, cuts = [], np.searchsorted(g, np.arange(groups + 1))
    for k in np.unique(g).tolist():
        own = slice(cuts[k], cuts[k + 1])
        ids, n = np.unique(sets[own], return_counts=True)
        out.append((k, kind, ids.tobytes(), n.astype(np.uint32).tobytes(), _six(np.ascontiguousarray(tokens[own])), df[own].tobytes()))
    return out


def _lists(groups: int):
    """Kernel over whole buckets: tokens in two sets or more go back to the groups of their sets, with their df."""

    def finish(rows):
        t, s = (np.concatenate(x) for x in zip(*map(_entries, rows), strict=True))
        order = np.lexsort([s, t])
        t, s = t[order], s[order]
        fresh = np.ones(len(t), bool)
        fresh[1:] = (t[1:] != t[:-1]) | (s[1:] != s[:-1])
        t, s = t[fresh], s[fresh]
        n = np.diff(np.append(np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])), len(t)))
        df = np.repeat(n, n)
        keep = df > 1
        return _back(_by_group(s[keep], t[keep], np.minimum(df[keep], 65_535).astype(np.uint16), groups, 0))

    def run(batches):
        held, last = [], None
        for b in batches:
            for k, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and k != last:
                    yield finish(held)
                    held = []
                last = k
                held.append(row)
        if held:
            yield finish(held)

    return run


def _sizes(groups: int):
    """Kernel: sizes of sets to their groups."""

    def run(batches):
        for b in batches:
            ids, first = np.unique(b.column(0).to_numpy(), return_index=True)
            size, g = b.column(1).to_numpy()[first].astype(np.uint32), _group_of(ids, groups)
            yield _back([(int(k), 1, ids[g == k].tobytes(), size[g == k].tobytes(), b"", b"") for k in np.unique(g)])

    return run


def _hot_parts(hot: np.ndarray, words: int, groups: int, clash: frozenset):
    """Kernel: hot tokens of sets to their groups."""

    def run(batches):
        for b in batches:
            sets, tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for t in b.column(0).to_pylist():
                s = shingle_set(t, words)
                if len(s) >= 3:
                    ids = tokens_of(s)
                    own = ids[hot[np.minimum(np.searchsorted(hot, ids), len(hot) - 1)] == ids]
                    sets.append(np.full(len(own), set_key(s, clash), np.int64))
                    tokens.append(own)
            s, t = np.concatenate(sets), np.concatenate(tokens)
            yield _back(_by_group(s, t, np.zeros(len(s), np.uint16), groups, 2))

    return run


_ACTIVE = "set_id long, s int, shared binary, n_shared int, prefix array<long>, place int, mins array<long>"


def _prefixes(batches):
    """Kernel over whole groups: per set, its shared tokens by (df, token), and the ones in the prefix (one more for
    pairs). Sets whose prefix holds no shared token are left out."""

    def finish(rows):
        size: dict[int, int] = {}
        sets, tokens, df = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for kind, ids, n, t, d in rows:
            ids, n = np.frombuffer(ids, np.int64), np.frombuffer(n, np.uint32)
            if kind == 1:
                size.update(zip(ids.tolist(), n.tolist(), strict=True))
                continue
            sets.append(np.repeat(ids, n))
            tokens.append(_from_six(t))
            df.append(np.full(len(tokens[-1]), 1 << 40) if kind == 2 else np.frombuffer(d, np.uint16).astype(np.int64))
        s, t, d = np.concatenate(sets), np.concatenate(tokens), np.concatenate(df)
        order = np.lexsort([t, d, s])
        s, t, d = s[order], t[order], d[order]
        fresh = np.ones(len(s), bool)  # copies of a set bring their hot tokens again
        fresh[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
        s, t = s[fresh], t[fresh]
        cut = np.append(np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])), len(s)) if len(s) else np.zeros(1, np.int64)
        out = []
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            n, own = size[int(s[lo])], t[lo:hi]
            alone = n - len(own)
            take = prefix_len(n) - alone
            if take > 0:
                mins = [int(_mix(own * _MUL[10 + k]).min()) >> 1 for k in range(MIN_HASHES)]
                out.append((int(s[lo]), n, _pack(np.sort(own)), len(own), own[: take + 1].view(np.int64).tolist(), alone, mins))
        columns = list(zip(*out, strict=True)) if out else [[]] * 7
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["set_id", "s", "shared", "n_shared", "prefix", "place", "mins"])

    held, last = [], None
    for b in batches:
        for g, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and g != last:
                yield finish(held)
                held = []
            last = g
            held.append(row)
    if held:
        yield finish(held)


def boundary(scan: float) -> int:
    """Largest set size for which enumerating pairs of the prefix costs no more than scanning its lists, at
    ``scan`` rows for each list entry."""
    x = 2
    while x < 400:
        p = prefix_len(x + 1)
        if (p + 1) * p / 2 > p * max(1.0, scan):
            break
        x += 1
    return x


def _keys(active: DataFrame, light: int) -> DataFrame:
    """(key, set_id, s, at, comp): list keys. Heavy (or reached by heavy): a prefix token and its place; light: a pair of prefix tokens."""
    n = F.size("prefix")
    full = F.expr("s - int((3 * s + 3) div 4) + 1 - place")
    tokens = F.slice("prefix", 1, F.least(n, full))
    heavy = active.where((F.col("s") > light) | (F.floor(F.col("s") * 4 / 3) > light))
    by_token = heavy.select("set_id", "s", "place", "comp", F.posexplode(tokens).alias("_i", "key")).select("key", "set_id", "s", (F.col("place") + F.col("_i")).alias("at"), "comp")
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.transform(F.sequence(i + 1, n), lambda j: F.xxhash64(F.element_at("prefix", i), F.element_at("prefix", j), F.lit(3)))))
    by_pair = active.where((F.col("s") <= light) & (n >= 2)).select(F.explode(pairs).alias("key"), "set_id", "s", F.lit(-1).alias("at"), "comp")
    return by_token.unionByName(by_pair)


def _can_link(s, r, at_s, at_r):
    """Sizes, and the places of the first shared token, allow a link."""
    enough = F.ceil((s + r) * 3 / 7)
    places = F.when((at_s < 0) | (at_r < 0), True).otherwise(F.least(s - at_s, r - at_r) >= enough)
    return (F.least(s, r) * 4 >= F.greatest(s, r) * 3) & places


def _check(pairs: DataFrame, active: DataFrame, few: bool) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets link, by counts of shared tokens. ``few``: the ids were counted and may be broadcast."""
    own = active.select("set_id", "s", "n_shared", "shared")
    if few:
        ids = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
        own = own.join(F.broadcast(ids), "set_id", "left_semi")
    side = lambda x: own.select(F.col("set_id").alias(x), F.col("s").alias(f"s_{x}"), F.col("n_shared").alias(f"n_{x}"), F.col("shared").alias(f"t_{x}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("n_a", "n_b") * 7 >= (F.col("s_a") + F.col("s_b")) * 3)

    def run(batches):
        for b in batches:
            last, last_key, keep = None, None, []
            for va, sa, na, ta, vb, sb, nb, tb in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if vb != last_key:
                    last, last_key = _unpack(tb, nb), vb
                keep.append(len(np.intersect1d(_unpack(ta, na), last, assume_unique=True)) >= need(sa, sb))
            k = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(k), b.column(4).filter(k)], ["a", "b"])

    cols = ["a", "s_a", "n_a", "t_a", "b", "s_b", "n_b", "t_b"]
    return rows.select(*cols).mapInArrow(run, "a long, b long")


def _active_sets(docs: DataFrame, sets: DataFrame, clash: frozenset, scratch: Scratch, words: int) -> tuple[DataFrame, int]:
    """Sets that share a token with another, with their prefixes, and the boundary of light sets."""
    spark = docs.sparkSession
    all_of = sets.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("tokens")).first()
    hot = _hot_tokens(docs, all_of["docs"], words)
    buckets = max(shuffle_parts(spark), -(-all_of["tokens"] // BUCKET))
    if buckets <= BLOCKS:
        routed = docs.select("text").mapInArrow(_routes(buckets, hot, words, clash), _ROUTED)
    else:
        coarse = int(np.ceil(np.sqrt(buckets)))
        fine = -(-buckets // coarse)
        buckets = coarse * fine
        routed = docs.select("text").mapInArrow(_routes(coarse, hot, words, clash), _ROUTED)
        routed = routed.repartition(coarse, "bucket").sortWithinPartitions("bucket").mapInArrow(_split(coarse, fine), _ROUTED)
    back = routed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_lists(buckets), _BACK)
    sizes = sets.where("n_shingles >= 3").select("set_id", "n_shingles").mapInArrow(_sizes(buckets), _BACK)
    back = back.unionByName(sizes)
    if len(hot):
        back = back.unionByName(docs.select("text").mapInArrow(_hot_parts(hot, words, buckets, clash), _BACK))
    active = back.repartition(buckets, "g").sortWithinPartitions("g").mapInArrow(_prefixes, _ACTIVE)
    active = scratch.store(active, "active")
    token = active.select(F.explode("prefix").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    cost = token.where("c > 1").agg(F.sum(F.col("c") * F.least("c", F.lit(SCAN))).alias("rows"), F.sum("c").alias("n")).first()
    return active, boundary(cost["rows"] / cost["n"] if cost["n"] else 1.0)


def _meet(rows: DataFrame, others: DataFrame, scratch: Scratch) -> DataFrame:
    """Join of ``rows`` (set_id) and ``others`` (a) on ``key``; a list of over ``LIST`` rows is dealt over salts, to each of which
    the others are copied."""
    long = scratch.store(rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > LIST).select("key", F.ceil(F.col("_n") / LIST).cast("int").alias("_salts")), "long")
    if long.isEmpty():
        return rows.join(others, "key")
    salts = lambda df: df.join(long, "key", "left").withColumn("_salts", F.coalesce("_salts", F.lit(1)))
    dealt = salts(rows).withColumn("_salt", F.pmod(F.xxhash64("set_id"), F.col("_salts")).cast("int")).drop("_salts")
    copied = salts(others).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    return dealt.join(copied, ["key", "_salt"]).drop("_salt")


def links(docs: DataFrame, sets: DataFrame, clash: frozenset, scratch: Scratch, words: int = WORDS) -> DataFrame:
    """(node, root): components of set ids that link with a different set."""
    active, light = _active_sets(docs, sets, clash, scratch, words)
    # contract: sets that agree in a min-hash meet the one of them with the fewest tokens of its own
    mins = active.select("set_id", "s", "place", F.posexplode("mins").alias("i", "m")).withColumn("m", F.xxhash64("i", "m"))
    leads = mins.groupBy("m").agg(F.min_by(F.struct("set_id", "s"), F.struct("place", "set_id")).alias("lead"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    star = attach_by_key(mins.select("set_id", "s", "m"), leads, "m", ["set_id"]).where("set_id <> lead.set_id").where(F.least("s", "lead.s") * 4 >= F.greatest("s", "lead.s") * 3)
    star = star.select(F.col("set_id").alias("a"), F.col("lead.set_id").alias("b")).distinct()
    edges = scratch.store(_check(star, active, False), "edges0")
    labels = scratch.store(components(edges, scratch, "cc0").select(F.col("node").alias("set_id"), F.col("root").alias("comp")), "labels0")
    # complete: in lists of several components, members outside the largest meet every other component's
    keyed = active.join(labels, "set_id", "left").withColumn("comp", F.coalesce("comp", "set_id"))
    keyed = scratch.store(_keys(keyed, light), "keys")
    counts = keyed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    mixed = counts.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("_major"), F.count(F.lit(1)).alias("_k")).where("_k > 1").drop("_k")
    left = scratch.store(keyed.join(mixed, "key"), "left")
    minor = left.where("comp <> _major").select("key", F.col("set_id").alias("a"), F.col("s").alias("s_a"), F.col("at").alias("at_a"), F.col("comp").alias("c_a"))
    pairs = _meet(left, minor, scratch).where((F.col("comp") != F.col("c_a")) & ((F.col("comp") == F.col("_major")) | (F.col("set_id") < F.col("a"))))
    pairs = pairs.where(_can_link(F.col("s"), F.col("s_a"), F.col("at"), F.col("at_a")))
    pairs = scratch.store(pairs.select(F.greatest("a", "set_id").alias("a"), F.least("a", "set_id").alias("b")).distinct(), "pairs")
    scratch.drop("keys", "left")
    more = scratch.store(_check(pairs, active, 2 * pairs.count() <= BROADCAST_ROWS), "edges1")
    scratch.drop("active", "pairs")
    if more.isEmpty():
        return labels.select(F.col("set_id").alias("node"), F.col("comp").alias("root"))
    # the links found last join whole components: only their roots go through the rounds again
    of = lambda x: labels.select(F.col("set_id").alias(x), F.col("comp").alias(f"{x}_root"))
    roots = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    upper = scratch.store(components(roots, scratch, "cc1"), "labels1")
    alone = labels.select(F.col("set_id").alias("node"), F.col("comp").alias("low")).unionByName(upper.select("node", F.col("node").alias("low"))).distinct()
    return alone.join(upper.select(F.col("node").alias("low"), "root"), "low", "left").select("node", F.coalesce("root", "low").alias("root")).distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    sets, clash = document_sets(docs, scratch, words)
    linked = links(docs, sets, clash, scratch, words)
    own = sets.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("low"))
    joined = own.join(linked.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    least = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    per_set = attach_by_key(joined, least, "root", ["set_id"]).select("set_id", "component_id")
    out = attach_by_key(sets, per_set, "set_id", ["doc_id"])
    return out.select("doc_id", "n_shingles", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def link_pairs(docs: DataFrame, sets: DataFrame, clash: frozenset, scratch: Scratch, words: int = WORDS) -> DataFrame:
    """(a, b), a > b: every two different sets that link, within components too, so m near copies are m^2 / 2 rows."""
    active, light = _active_sets(docs, sets, clash, scratch, words)
    keyed = scratch.store(_keys(active.withColumn("comp", F.col("set_id")), light).drop("comp"), "keys")
    other = keyed.select("key", F.col("set_id").alias("a"), F.col("s").alias("s_a"), F.col("at").alias("at_a"))
    pairs = _meet(keyed, other, scratch).where((F.col("a") > F.col("set_id")) & _can_link(F.col("s"), F.col("s_a"), F.col("at"), F.col("at_a")))
    pairs = scratch.store(pairs.select("a", F.col("set_id").alias("b")).distinct(), "pairs")
    out = scratch.store(_check(pairs, active, 2 * pairs.count() <= BROADCAST_ROWS), "edges")
    scratch.drop("active", "keys", "pairs")
    return out


def link_counts(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, n_links) for every row of ``docs``: the other rows whose sets are equal or link."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    sets, clash = document_sets(docs, scratch, words)
    found = link_pairs(docs, sets, clash, scratch, words)
    rows = sets.where("set_id is not null").groupBy("set_id").agg(F.count(F.lit(1)).alias("_rows"))
    both = found.select(F.col("a").alias("set_id"), F.col("b").alias("_other")).unionByName(found.select(F.col("b").alias("set_id"), F.col("a").alias("_other")))
    far = both.join(rows.withColumnRenamed("set_id", "_other"), "_other").groupBy("set_id").agg(F.sum("_rows").alias("_far"))
    n = rows.join(far, "set_id", "left").select("set_id", (F.col("_rows") - 1 + F.coalesce("_far", F.lit(0))).alias("n_links"))
    return attach_by_key(sets, n, "set_id", ["doc_id"]).select("doc_id", "n_shingles", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The rows of ``docs`` that are the smallest doc_id of their component (or have a null doc_id)."""
    found = near_duplicates(docs, words).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                          ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d),
t AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= 75 * (na + nb - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, cast(len(g) AS bigint) AS n_shingles, component_id FROM s JOIN c USING (doc_id)
"""
