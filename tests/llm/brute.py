"""Plain versions of the operators, for comparison on small tables."""

import random
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def quality_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i:i + 8])].append(i)
    hit = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return {"n_words": n, "word_chars": sum(map(len, words)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
            "n_dup_lines": dup, "n_repeat_words": len(hit), "base_failed": n < 20 or 100 * len(hit) > 30 * n}


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[j:j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def overlaps(sets):
    """(i, j, overlap) with j < i for sets that share a member."""
    post = defaultdict(list)
    for i, s in enumerate(sets):
        count = defaultdict(int)
        for x in s:
            for j in post[x]:
                count[j] += 1
            post[x].append(i)
        for j, c in count.items():
            yield i, j, c


def near_groups(rows):
    """(n_shingles, component_id) for each (doc_id, text), ids distinct."""
    sets, u = [shingles(t) for _, t in rows], Union()
    for i, j, c in overlaps(sets):
        if 100 * c >= 75 * (len(sets[i]) + len(sets[j]) - c):
            u.link(rows[i][0], rows[j][0])
    return {d: (len(s), u.find(d)) for (d, _), s in zip(rows, sets)}


def line_keepers(rows, similar=0.8):
    """(doc_id, line_no) -> place of the kept line, ids distinct and not null."""
    lines = {(d, n): line for d, t in rows for n, line in enumerate((t or "").split("\n")) if WORD.search(line)}
    distinct = sorted(set(lines.values()))
    sets = [frozenset(x.lower()[m.start():m.start() + 12] for m in WORD.finditer(x)) for x in distinct]
    u = Union()
    for i, j, c in overlaps(sets):
        if c >= similar * (len(sets[i]) + len(sets[j]) - c):
            u.link(distinct[i], distinct[j])
    keep = {}
    for place in sorted(lines):
        keep.setdefault(u.find(lines[place]), place)
    return {place: keep[u.find(line)] for place, line in lines.items()}


def prose(seed, n):
    r = random.Random(seed)
    words = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 9))) for _ in range(max(40, n // 3))]
    return " ".join(r.choice(words) + ("\n" if i % 17 == 16 else "") for i in range(n))


def url_templates(urls, prior=10.0, children=12, each=4, deviate=1.96):
    """{(host, segments): (template, purity)} from rows (host, segments, label or None), by recursion."""
    labelled = [x for _, _, x in urls if x is not None]
    good = 1 - sum(labelled) / len(labelled) if labelled else 1.0
    smooth = lambda n, bad, above: (n - bad + prior * above) / (n + prior)
    out = {}

    def counts(rows):
        known = [x for _, _, x in rows if x is not None]
        return len(known), sum(known)

    def grow(host, node, rows, purity):
        n, bad = counts(rows)
        if not 0 < bad < n:
            for full, rest, _ in rows:
                out[host, full] = (node + ("/**" if rest else ""), purity)
            return
        kids = defaultdict(list)
        for row in rows:
            kids[row[1][0] if row[1] else ""].append(row)
        rare = {s for s, r in kids.items() if s and len(r) < each}
        pieces = defaultdict(list)
        for s, r in kids.items():
            pieces["*" if s in rare and len(rare) >= children else s.replace("*", "%2A")] += r

        def apart(m, b):
            if m == 0 or m == n:
                return False
            share = bad / n
            error = (max(share * (1 - share), 1e-3) * (1 / m + 1 / (n - m))) ** 0.5
            return abs(b / m - (bad - b) / (n - m)) > deviate * error

        differ = {p: apart(*counts(r)) for p, r in pieces.items()}
        alike = counts([x for p, r in pieces.items() if not differ[p] for x in r])
        for p, r in pieces.items():
            own = smooth(*counts(r), purity) if differ[p] else smooth(*alike, purity) if any(differ.values()) else purity
            if p == "":
                for full, _, _ in r:
                    out[host, full] = (node, own)
                continue
            tails = [rest[1:] for _, rest, _ in r]
            shared = 0
            while all(len(t) > shared for t in tails) and len({t[shared] for t in tails}) == 1:
                shared += 1
            path = [p] + [s.replace("*", "%2A") for s in tails[0][:shared]]
            grow(host, node + "/" + "/".join(path), [(full, rest[1 + shared:], x) for full, rest, x in r], own)

    for host in {h for h, _, _ in urls}:
        rows = [(s, s, x) for h, s, x in urls if h == host]
        grow(host, "", rows, smooth(*counts(rows), good))
    return out
