"""Names that join the registry in rounds end as when they join one after another."""

import random
import re

from studyloom.operators import identity


def one_after_another(names, registry):
    slug = lambda t: re.sub(r"^-+|-+$", "", re.sub(r"[^a-z0-9]+", "-", t.strip().lower()))[:80]
    known = [{"id": i, "of": None, "canonical": c, "aliases": list(a)} for i, c, a in sorted(registry)]
    out, seen = [], set()
    for name, description, _ in sorted(names, key=lambda x: x[2]):
        if name in seen:
            continue
        seen.add(name)
        low, part = name.strip().lower(), (description or "").strip().lower()[:20]
        scored = []
        for place, k in enumerate(known):
            canon = k["canonical"].lower()
            a, b = canon.split(), low.split()
            overlap = sum(w in b for w in a) / max(len(a), len(b))
            ratio = min(len(low), len(canon)) / max(len(low), len(canon)) if low in canon or canon in low else overlap
            is_slug, is_alias = slug(k["canonical"]) == slug(name), low in [x.lower() for x in k["aliases"]]
            if is_slug or is_alias or (part and part in canon) or ratio >= 0.6:
                scored.append((-(1.0 if is_slug else 0.95 if is_alias else round(overlap, 9)), place))
        best = min(scored, default=(0.0, None))
        hints = sum(0.6 <= -s < 0.85 for s, _ in scored)
        if -best[0] >= 0.85:
            k = known[best[1]]
            k["aliases"].append(name)
            out.append((name, "slug" if best[0] == -1 else "match", k["id"], k["of"], -best[0], 0 if best[0] == -1 else hints))
        else:
            known.append({"id": None, "of": name, "canonical": name, "aliases": []})
            out.append((name, "new", None, None, -best[0], hints))
    return sorted(out, key=str)


def test_rounds(spark):
    rng = random.Random(9)
    vocabulary = "red blue green old new iron".split()
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    registry = [(i, f"{some(3)} {i % 3}", [some(2)]) for i in range(6)]
    names = []
    for at in range(150):
        name = some(rng.choice([1, 2, 3, 7])) if at % 4 else rng.choice(names or [("red", None, 0)])[0]
        name = rng.choice([name, name, name.upper(), name.replace(" ", "-"), f"{name} {rng.choice(vocabulary)}"])
        names.append((name, rng.choice([None, "", "Green old", "x"]), at))
    names += [(registry[0][1].upper(), None, 500), (registry[1][2][0].upper(), None, 501)]
    df = spark.createDataFrame(names, "name string, description string, at long")
    reg = spark.createDataFrame(registry, "id long, canonical string, aliases array<string>")
    got = sorted((tuple(r) for r in identity.resolve_in_order(df, reg).collect()), key=str)
    want = one_after_another(names, registry)
    assert [(*g[:4], round(g[4], 6), g[5]) for g in got] == [(*w[:4], round(w[4], 6), w[5]) for w in want]


def test_nothing_known(spark):
    reg = spark.createDataFrame([], "id long, canonical string, aliases array<string>")
    df = spark.createDataFrame([("b c d", None, 2), ("B C D", None, 3), ("b c d", None, 1)], "name string, description string, at long")
    got = {r["name"]: (r["outcome"], r["of"]) for r in identity.resolve_in_order(df, reg).collect()}
    assert got == {"b c d": ("new", None), "B C D": ("slug", "b c d")}
    assert identity.resolve_in_order(df.limit(0), reg).collect() == []
