"""String ratios on 0 to 100, for distinct pairs that blocking and equality have left over."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence; one bit per character of a."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def plain_ratio(a: str, b: str) -> float:
    return 200 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def plain_token_sort(a: str, b: str) -> float:
    return plain_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def plain_token_set(a: str, b: str) -> float:
    """Best ratio of the shared words, and of these with each side's other words; 100 if one side holds the other."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, one, two = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not one or not two):
        return 100.0
    left, right = f"{both} {one}".strip(), f"{both} {two}".strip()
    return max(plain_ratio(left, right), *((plain_ratio(both, left), plain_ratio(both, right)) if both else (0.0,)))


def best_window(needle: str, hay: str, least: float) -> tuple[int, int, float] | None:
    """Begin, end and score of the stretch of hay, at most as long as needle, that is most like it; the first of equals, none below `least`.

    The score is 200 times the longest common subsequence over both lengths. The characters that a stretch shares with needle,
    in any order, bound it; stretches are tried by that bound, so that few of a long text are compared.
    """
    if len(hay) < len(needle):
        turned = best_window(hay, needle, least) if hay else None
        return turned and (0, len(hay), turned[2])
    m, n = len(needle), len(hay)
    text = np.frombuffer(hay.encode("utf-32-le"), np.uint32)
    begin = np.concatenate([np.zeros(m - 1, np.int64), np.arange(n - m + 1), np.arange(n - m + 1, n)])
    end = np.concatenate([np.arange(1, m), np.arange(m, n + 1), np.full(m - 1, n)])
    shared = np.zeros(len(begin), np.int64)
    for c in set(needle):
        seen = np.concatenate(([0], np.cumsum(text == ord(c))))
        shared += np.minimum(seen[end] - seen[begin], needle.count(c))
    bound = 200 * shared / (m + end - begin)
    some = np.flatnonzero(bound >= least)
    best = None
    for k in some[np.argsort(-bound[some], kind="stable")]:
        if best and bound[k] < best[0]:
            break
        score = 200 * common(needle, hay[begin[k] : end[k]]) / (m + end[k] - begin[k])
        if score >= least and (best is None or (score, -k) > (best[0], -best[1])):
            best = (score, int(k))
    return best and (int(begin[best[1]]), int(end[best[1]]), float(best[0]))


def plain_partial(a: str, b: str) -> float:
    """Best ratio of the shorter text with a stretch of the longer one; 100 for two empty texts, 0 for one."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    short, long = sorted((a, b), key=len)
    found = [best_window(short, long, 0.0), best_window(long, short, 0.0) if len(a) == len(b) else None]
    return max(x[2] for x in found if x)


def plain_weighted(a: str, b: str) -> float:
    """The ratio, or a little less for agreement of sorted words, of word sets, and, for texts of unlike lengths, of parts."""
    if not a or not b:
        return 0.0
    unlike = max(len(a), len(b)) / min(len(a), len(b))
    whole = plain_ratio(a, b)
    if unlike < 1.5:
        return max(whole, 0.95 * max(plain_token_sort(a, b), plain_token_set(a, b)))
    scale = 0.9 if unlike <= 8 else 0.6
    x, y = set(a.split()), set(b.split())
    words = 100.0 if x & y else max(plain_partial(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), plain_partial(" ".join(sorted(x - y)), " ".join(sorted(y - x))))
    return max(whole, scale * plain_partial(a, b), 0.95 * scale * words)


def _udf(rule):
    @F.pandas_udf(T.DoubleType())
    def ratios(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([rule(x, y) if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(a, b, strict=True)], dtype="float64")

    return ratios


partial_ratio, weighted_ratio = _udf(plain_partial), _udf(plain_weighted)
#: 200 * common subsequence / summed lengths; the same after sorting words; and on sets of words. Null if a side is.
ratio, token_sort_ratio, token_set_ratio = _udf(plain_ratio), _udf(plain_token_sort), _udf(plain_token_set)
