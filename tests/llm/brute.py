"""Plain Python forms of the numbered operators, and texts with edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower_az(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})


def words(text) -> list[str]:
    return WORDS.findall(text or "")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def invented(n: int, seed: int, names: int = 4000) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(names)}" for _ in range(n))


def edge_texts() -> dict[int, str | None]:
    """By id: null, empty, blank, short, very long, copies, near copies, shared passages, odd characters."""
    base, passage = invented(300, 1), invented(80, 2)
    parts = base.split(" ")
    texts = {
        1: None, 2: "", 3: " \t\n ", 4: "one", 5: "one", 6: "One two", 7: "a b c d", 8: "a b c d e", 9: base, 10: base, 11: base.upper(),
        12: " ".join(parts[:290]), 13: " ".join(parts[:150] + ["changed"] + parts[151:]), 14: " ".join(parts[:100]), 15: passage, 16: f"{invented(40, 3)} {passage} {invented(40, 4)}",
        17: f"{invented(30, 5)}\n{passage}", 18: f"{passage}\t{passage}", 19: "x " * 400, 20: invented(20000, 6, 10**6), 21: "ÄÖ é\u00a0\u3000 \U0001f600 İ ı \u2028 it's we'll IT'S '  ' ''s 123abc ４２",
        22: "don't   stop\n\n\nnow  \n x", 23: "a" * 5000, 24: "<|endoftext|>a<|endoftext|><|endoftext|>", 25: "\\<|turn|>\u0000\u0001", 26: "ß" * 300 + " " + "9" * 700,
        27: "same line\nsame line\nother\nsame line\n\n", 28: "one\x0btwo\x0cthree four five six seven eight nine ten eleven", 29: "!!! #$% |||| <> &&& ***",
    }
    for i in range(40):
        texts[100 + i] = base if i % 2 else " ".join(parts[i % 20:])
    for i in range(25):
        texts[200 + i] = f"{invented(60, 50 + i)} {passage if i % 3 else ' '.join(passage.split()[10:75])} {invented(30, 90 + i)}"
    return texts


def near(texts: dict[int, str | None]) -> dict[int, tuple[int, int, bool]]:
    sets = {}
    for i, text in texts.items():
        w = words(lower_az(text or ""))
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    above = {i: i for i in texts}

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                above[b] = a
    return {i: (len(sets[i]), top(i), top(i) == i) for i in ids}


def cut_windows(texts: dict[int, str | None], width: int = 50) -> dict[int, tuple[int, int, str]]:
    first: dict[tuple, int] = {}
    lists = {i: words(t) for i, t in texts.items()}
    for i in sorted(texts):
        for k in range(len(lists[i]) - width + 1):
            first.setdefault(tuple(lists[i][k:k + width]), i)
    out = {}
    for i, w in lists.items():
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k:k + width])] < i:
                gone[k:k + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), kept)
    return out


def base_statistics(text) -> dict[str, int]:
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    grams = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
    often, hit = Counter(grams), set()
    for k, g in enumerate(grams):
        if often[g] > 1:
            hit.update(range(k, k + 5))
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit),
        "base_failed": len(w) < 10 or 100 * len(hit) > 20 * len(w),
    }


def exact(texts: dict[int, str | None]) -> dict[int, tuple[int, int, bool, str]]:
    groups = defaultdict(list)
    for i, t in texts.items():
        groups[lower_az(t or "")].append(i)
    return {i: (max(ids), len(ids), i == max(ids), sha(t)) for t, ids in groups.items() for i in ids}
