"""Plain Python versions of the operators, and awkward documents."""

from __future__ import annotations

import hashlib
import itertools
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs(spark, texts, first=0, **extra):
    """Documents numbered from ``first``; ``texts`` may hold (id, text) pairs."""
    rows = [t if isinstance(t, tuple) else (first + i, t) for i, t in enumerate(texts)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    df = spark.createDataFrame(rows, DOCS) if rows else spark.createDataFrame([], DOCS)
    for name, value in extra.items():
        df = df.withColumn(name, value)
    return df


def components(n, links):
    label = list(range(n))

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i, j in links:
        a, b = root(i), root(j)
        label[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def shingles(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def similar(a, b):
    both = len(a & b)
    return bool(a) and bool(b) and 100 * both >= 80 * (len(a) + len(b) - both)


def near_groups(rows):
    """(doc_id, n_shingles, component_id) of (doc_id, text) rows."""
    sets = [shingles(t) for _, t in rows]
    order = [i for i, _ in rows]
    label = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if similar(sets[i], sets[j])])
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [order[j] for j in range(len(rows)) if label[j] == label[i] and order[j] is not None]
        out.append((doc, len(sets[i]), min(ids) if sets[i] and ids else doc))
    return out


def copies(rows):
    body = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = {}
    for i, b in enumerate(body):
        groups.setdefault(b, []).append(i)
    out = []
    for i, (doc, _) in enumerate(rows):
        same = groups[body[i]]
        ids = [rows[j][0] for j in same if rows[j][0] is not None]
        out.append((doc, min(ids) if ids else None, len(same), hashlib.sha256(body[i].encode()).hexdigest()))
    return out


def leaks(rows, items, window=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))

    out = []
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            v = words(t)
            n = min(window, len(v))
            for i in range(len(v) - n + 1 if v else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[i : i + n]:
                        hit.update(range(p, p + n))
                        found.add(item)
        names = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out


def repeated_words(rows, run=50):
    """(row, word) of all words in windows of ``run`` words that several rows hold, and those of them whose window occurs earlier."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) for _, t in rows]
    places = {}
    for i in sorted(range(len(rows)), key=lambda i: none_last((rows[i][0],))):
        for p in range(len(words[i]) - run + 1):
            places.setdefault(tuple(words[i][p : p + run]), []).append((i, p))
    shared = [x for x in places.values() if len({i for i, _ in x}) > 1]
    spread = lambda x: {(i, p + k) for i, p in x for k in range(run)}
    return set().union(*map(spread, shared)), set().union(*(spread(x[1:]) for x in shared))


def none_last(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def word_runs(words, least=24, times=3):
    """(start, length, period) of all longest stretches with smallest period, period by period."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        start = None
        for i in range(n - q + 1):
            if i < n - q and words[i] == words[i + q]:
                start = i if start is None else start
                continue
            if start is not None and (length := i - start + q) >= max(least, times * q):
                stretch = words[start : start + length]
                if not any(stretch[:-p] == stretch[p:] for p in range(1, q)):
                    out.append((start, length, q))
            start = None
    return sorted(out, key=lambda r: (r[0], r[2]))


def cut_lines(rows, least=10):
    """(doc_id, n_lines, n_dropped, kept text) of (doc_id, text) rows."""
    key = lambda line: line.strip(" \t\n\r\x0b\x0c").translate(LOWER)
    holders = {}
    for r, (doc, text) in enumerate(rows):
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                holders.setdefault(key(line), {})[r] = doc
    out = []
    for doc, text in rows:
        lines, kept = (text or "").split("\n"), []
        for line in lines:
            ids = [i for i in holders.get(key(line), {}).values() if i is not None]
            if not (len(holders.get(key(line), {})) >= 2 and ids and (doc is None or doc > min(ids))):
                kept.append(line)
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def filter_effects(rows, labels):
    """Result rows of the filter audit, order by order, of (doc_id, text, part) rows."""
    docs = []
    for doc, text, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
            "E": doc is not None and any(i is not None and i < doc and (t or "") == text for i, t, _ in rows),
        }
        mine = [(q, x) for i, q, x in labels if i is not None and i == doc]
        docs.append((part or "", fails, any(q == 1 for q, _ in mine), any(x == 1 for _, x in mine)))
    out = []
    for part in {d[0] for d in docs}:
        total = {}
        for order in itertools.permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            seen = list(left)
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                all_fails = [d for d in seen if d[1][f]]
                alone = [d for d in seen if d[1][f] and sum(d[1].values()) == 1]
                total[f] = total.get(f, 0) + len(gone)
                out.append([part, "".join(order), step, len(left), len(gone), len(all_fails) - len(gone), len(alone), sum(d[2] for d in gone), sum(d[3] for d in gone), f])
        for r in out:
            if r[0] == part:
                r[-1] = total[r[-1]]
    return sorted(map(tuple, out))
