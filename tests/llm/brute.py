"""Plain versions of what the contracts ask, for small inputs."""

import hashlib
import itertools
import math
import re
import statistics
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def secrets(text):
    text = text or ""
    assign = [
        m
        for m in re.finditer(
            r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
            r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
            text,
        )
        if len(m.group(2)) >= 12
    ]
    access = [m for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    hexes = [m for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 16]
    spans = sorted(
        (m.start(), k, m.end()) for k, found in enumerate((assign, access, hexes)) for m in found
    )
    joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in spans)
    return len(assign), len(access), len(hexes), sha(joined), joined


def repeats(docs, size=50):
    """{id: (bytes, removed, runs, digest)} of (id, text) with distinct ids."""
    texts = {i: (t or "").encode() for i, t in docs}
    least = {}
    for i in sorted(texts, reverse=True):
        for p in range(len(texts[i]) - size + 1):
            least[texts[i][p : p + size]] = i
    out = {}
    for i, t in texts.items():
        gone = bytearray(len(t))
        for p in range(len(t) - size + 1):
            if least[t[p : p + size]] < i:
                gone[p : p + size] = b"\1" * size
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(t), len(t) - len(kept), runs, sha(kept))
    return out


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def near(docs):
    """({id: (size, component)}, links) of (id, text) with distinct ids."""
    sets = {i: shingles(t) for i, t in docs}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    overlap = Counter()
    for ids in holders.values():
        ids.sort()
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                overlap[a, b] += 1
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = set()
    for (a, b), n in overlap.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            links.add((a, b))
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}, links


def jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def shard_rows(docs, shards=8):
    placed = []
    for i, t in docs:
        data = (t or "").encode()
        digest = hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()
        key = int(digest[:16], 16)
        placed.append((jump(key, shards), digest, i, len(data) + 1, zlib.crc32(data), jump(key, shards + 1)))
    placed.sort(key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0))
    slots = Counter()
    out = []
    for shard, _, i, size, crc, grown in placed:
        out.append((i, size, crc, "key", shard, slots[shard], grown))
        slots[shard] += 1
    return out


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    often = Counter(windows)
    hit = set()
    for k, w in enumerate(windows):
        if often[w] > 1:
            hit.update(range(k, k + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, r = len(words), len(hit)
    return (
        n,
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        r,
        n < 20 or 100 * r > 30 * n,
    )


def targets(sizes, most=3):
    """{source: target} of {source: size}; None is the last source."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, out, left = sum(sizes.values()), {}, set(order)
    while left:
        rest = total - sum(out.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        above = [s for s in left if share[s] > most * sizes[s]]
        if not above:
            out.update(share)
            break
        for s in above:
            out[s] = most * sizes[s]
            left.discard(s)
    return out


def chat(rows):
    """{conv: (turns, digest, loss chars, loss digest)} of (conv, turn, role, text)."""
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss))
    return out


# --- Vectors ---


def integers(vector, scale=1024):
    """Exact floors, or None for a vector that takes no part."""
    if vector is None or any(x is None or x != x or abs(x) == float("inf") for x in vector):
        return None
    return [int(x * scale // 1) if abs(x) < 2**53 else int(x) * scale for x in vector]


def clustered(rows, count=8, rounds=10):
    """Multiset of (id, cluster, distance, cluster inertia, inertia, digest) of (id, vector)."""
    kept = [(i, integers(v)) for i, v in rows if integers(v) is not None and len(v) == 64]
    drawn = sorted((sha(f"3:{i}"), v) for i, v in kept if i is not None)
    centroids = [v for _, v in drawn[:count]]

    def assign():
        out = []
        for _, v in kept:
            out.append(min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)))
        return out

    for _ in range(rounds):
        best = assign()
        for n in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(kept, best) if c == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine)]
    best = assign()
    inertia = Counter()
    for d, c in best:
        inertia[c] += d
    digests = [sha(",".join(map(str, c))) for c in centroids]
    return Counter((i, c, d, inertia[c], sum(inertia.values()), digests[c]) for (i, _), (d, c) in zip(kept, best))


def searched(rows, k=10, step=100):
    """Multiset of (query id, rank, id, score) of (id, vector)."""
    kept = [(i, integers(v)) for i, v in rows if integers(v) is not None]
    out = Counter()
    for q, (name, asked) in enumerate(kept):
        if name is None or name % step:
            continue
        found = sorted(
            (-sum(a * b for a, b in zip(asked, v)), i is None, i if i is not None else 0, p)
            for p, (i, v) in enumerate(kept)
            if p != q
        )
        for rank, (score, no_id, i, _) in enumerate(found[:k], 1):
            out[(name, rank, None if no_id else i, -score)] += 1
    return out


# --- Merkle trees ---


def leaf(doc_id, source, lang, n_chars, text):
    values = (doc_id, source, lang, n_chars, text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    """Per node its (left, digest) siblings from the bottom up, and the root."""
    level, places = list(nodes), list(range(len(nodes)))
    paths = [[] for _ in nodes]
    while len(level) > 1:
        for n, p in enumerate(places):
            beside = p ^ 1
            paths[n].append((p % 2 == 1, level[beside] if beside < len(level) else None))
        level = [sha("".join(level[p : p + 2])) for p in range(0, len(level), 2)]
        places = [p // 2 for p in places]
    return paths, level[0]


def fold(node, path):
    for left, beside in path:
        node = sha((beside or "") + node if left else node + (beside or ""))
    return node


def manifest(docs):
    """Multiset of result rows of (doc_id, text, lang, source, n_chars)."""
    trees = defaultdict(list)
    for i, t, lang, source, n in docs:
        hit = i is not None and zlib.crc32(str(i).encode()) % 7 == 0 and n is not None
        true = leaf(i, source, lang, n, t)
        trees[lang].append((i is not None, i or 0, true, leaf(i, source, lang, n + 1, t) if hit else true, i))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    grown = {x: (sorted(trees[x]), *climb([r[2] for r in sorted(trees[x])])) for x in names}
    crown, root = climb([grown[x][2] for x in names]) if names else ([], None)
    out = Counter()
    for x, above in zip(names, crown):
        rows, paths, subroot = grown[x]
        for (_, _, true, bad, i), path in zip(rows, paths):
            whole_path = path + above
            folded = fold(bad, whole_path)
            proof = sha("".join(d for _, d in whole_path if d is not None))
            out[(i, true, subroot, root, proof, folded, folded == root)] += 1
    return out


# --- Rows whose ids may be NULL or repeated ---


def repeats_of_rows(rows, size=50):
    """Multiset of (id, bytes, removed, runs, digest) of (id, text), each row a document."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, t in texts:
        for p in range(len(t) - size + 1):
            key = t[p : p + size]
            rank = float("inf") if i is None else i
            least[key] = min(least.get(key, float("inf")), rank)
    out = Counter()
    for i, t in texts:
        own = float("inf") if i is None else i
        gone = bytearray(len(t))
        for p in range(len(t) - size + 1):
            if least[t[p : p + size]] < own:
                gone[p : p + size] = b"\1" * size
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[(i, len(t), len(t) - len(kept), runs, sha(kept))] += 1
    return out


def near_rows(rows):
    """Multiset of (id, size, component, links to different sets) of (id, text), each row a document."""
    found, links = near([(k, t) for k, (_, t) in enumerate(rows)])
    sets = [frozenset(shingles(t)) for _, t in rows]
    names, partners = defaultdict(list), defaultdict(set)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            names[found[k][1]].append(i)
    for a, b in links:
        if sets[a] != sets[b]:
            partners[sets[a]].add(sets[b])
            partners[sets[b]].add(sets[a])
    return Counter(
        (i, found[k][0], min(names[found[k][1]], default=None), len(partners[sets[k]])) for k, (i, _) in enumerate(rows)
    )


# --- Randomness of strings ---


def joint_p(token, letters):
    """Chi-squared, runs and lag-one tests over an alphabet, joined by Fisher's method."""
    values = [letters.index(c) for c in token]
    n, k = len(values), len(letters)

    def tail(z):
        return (1 - statistics.NormalDist().cdf(z)) if z < 6 else 0.5 * math.erfc(z / math.sqrt(2))

    chi = sum((values.count(v) - n / k) ** 2 / (n / k) for v in range(k))
    # Wilson and Hilferty's cube root makes the statistic normal.
    spread = 2 / (9 * (k - 1))
    p_letters = tail(((chi / (k - 1)) ** (1 / 3) - (1 - spread)) / math.sqrt(spread))
    upper = [v >= k / 2 for v in values]
    a, b = upper.count(True), upper.count(False)
    p_runs = p_lag = 2.0 ** (1 - n)
    if a and b:
        runs = len([1 for _ in itertools.groupby(upper)])
        mean = 1 + 2 * a * b / n
        variance = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
        p_runs = 2 * tail(abs(runs - mean) / math.sqrt(variance))
    centre = statistics.fmean(values)
    power = sum((v - centre) ** 2 for v in values)
    if power:
        lag = sum((x - centre) * (y - centre) for x, y in zip(values, values[1:])) / power
        p_lag = 2 * tail(abs(lag) * math.sqrt(n))
    x = sum(-math.log(min(1.0, max(p, 1e-300))) for p in (p_letters, p_runs, p_lag))
    # Survival function of chi-squared with six degrees of freedom at 2x.
    return math.exp(-x) * (1 + x + x**2 / 2)


def bars(counts, prior=40, most_false=0.05):
    out = {}
    for key, seen in counts.items():
        bins = len(seen)
        random_ones = 2 * (sum(seen[bins // 2 :]) + prior / 2)
        random_ones = min(random_ones, sum(seen) + prior)
        fits = [
            low
            for low in range(1, bins)
            if (sum(seen[low:]) + prior * (bins - low) / bins) * (1 - most_false) <= random_ones * (bins - low) / bins + 1e-9
        ]
        out[key] = min(fits, default=bins)
    return out


# --- Toxicity: the rules for a clause, read off one word after another ---


def clause_score(tokens, weight, insults, threats, targets, negations, reports):
    """Weights of insults and threats by what came before them in the clause."""
    total, since_negation, reported, targeted = 0.0, None, False, False
    insult_count, threat_age, target_seen = 0, None, False
    for token in tokens:
        kind = (
            "I" if weight(token) > 0 else "T" if token in threats else "N" if token in negations
            else "R" if token in reports else "Y" if token in targets else "."
        )
        negated = 0.25 if since_negation is not None and since_negation < 3 else 1.0
        if kind == "N":
            negated = 1.0
        report = 1.0 if kind == "R" else (0.5 if reported else 1.0)
        target = 1.0 if kind == "Y" else (1.5 if targeted else 1.0)
        if kind == "I":
            total += weight(token) * (1.0 + 0.25 * min(insult_count, 2)) * target * negated * report
            insult_count += 1
        if kind == "T":
            # A threat after a target counts at once, else it waits three words for one.
            if target_seen:
                total += 3.0 * negated * report
                threat_age = None
            else:
                threat_age = 0
        elif kind == "Y":
            if threat_age is not None:
                total += 3.0 * negated * report
            threat_age, target_seen = None, True
        elif threat_age is not None:
            threat_age += 1
            if threat_age == 3:
                threat_age = None
        since_negation = 0 if kind == "N" else None if since_negation is None else since_negation + 1
        reported |= kind == "R"
        targeted |= kind == "Y"
    return total
