"""Strong components, cycles of any length, peeling, and dual quotas against plain Python."""

import random
from collections import Counter, defaultdict

import pytest

from ashlar.operators import dependencies as deps
from ashlar.operators import risk as k
from ashlar.operators import tasks as t


def tarjan(edges):
    """Node to the least node of its strongly connected component."""
    after = defaultdict(list)
    for a, b in edges:
        after[a].append(b)
    index, low, stack, on, out = {}, {}, [], set(), {}
    for root in sorted({x for e in edges for x in e}):
        work = [(root, iter(after[root]))] if root not in index else []
        if work:
            index[root] = low[root] = len(index)
            stack.append(root)
            on.add(root)
        while work:
            v, rest = work[-1]
            for w in rest:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(after[w])))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    at = stack.index(v)
                    own, stack[at:] = stack[at:], []
                    on -= set(own)
                    out |= dict.fromkeys(own, min(own))
    return out


def every_cycle(edges):
    after, out = defaultdict(set), set()
    for a, b in edges:
        after[a].add(b)

    def go(path):
        for b in after[path[-1]]:
            if b == path[0]:
                out.add(tuple(path))
            elif b > path[0] and b not in path:
                go([*path, b])

    for a in list(after):
        go([a])
    return out


CHAIN = [(i, i + 1) for i in range(12)] + [(12, 6), (5, 5), (20, 21), (21, 20), (12, 20), (30, 31)]


def frame(spark, edges):
    return spark.createDataFrame([*edges, *edges[:2], (None, 1), (1, None)], "source int, target int")


@pytest.mark.parametrize("seed", [None, 1, 2])
def test_components_and_cycles(spark, seed):
    rng = random.Random(seed)
    edges = CHAIN if seed is None else [(rng.randrange(40), rng.randrange(40)) for _ in range(48)]
    assert {r.node: r.component for r in deps.strong_components(frame(spark, edges)).collect()} == tarjan(edges)
    found = [tuple(r.cycle) for r in deps.cycles(frame(spark, edges)).collect()]
    assert sorted(found) == sorted(every_cycle(edges))
    assert max(map(len, every_cycle(CHAIN))) == 7
    short = [tuple(r.cycle) for r in deps.cycles(frame(spark, edges), 3).collect()]
    assert sorted(short) == sorted(c for c in every_cycle(edges) if len(c) <= 3)


def test_no_edges(spark):
    none = frame(spark, []).where("source > 100")
    assert deps.strong_components(none).count() == 0 and deps.cycles(none).count() == 0 and deps.levels(none).count() == 0
    assert deps.longest_path(none).first().depth == 0


def test_levels(spark):
    rng = random.Random(3)
    edges = [tuple(sorted(rng.sample(range(60), 2))) for _ in range(120)]
    level = defaultdict(lambda: 1)
    for a, b in sorted(edges):
        level[b] = max(level[b], level[a] + 1)
    nodes = {x for e in edges for x in e}
    assert {r.node: r.level for r in deps.levels(frame(spark, edges).where("source IS NOT NULL AND target IS NOT NULL")).collect()} == {n: level[n] for n in nodes}
    looped = [(1, 2), (2, 3), (3, 2), (3, 4), (1, 5)]
    assert {r.node: r.level for r in deps.levels(frame(spark, looped).where("source IS NOT NULL AND target IS NOT NULL")).collect()} == {1: 1, 5: 2}


@pytest.mark.parametrize("quotas", [(2, 9), (4, 3), (0, 5)])
def test_quotas_are_those_of_reading_in_order(spark, quotas):
    rng = random.Random(quotas[1])
    rows = [(i, rng.choice("ppppq"), rng.choice(["f%d" % min(20, int(rng.expovariate(0.1))), None]), rng.choice(["r%d" % min(8, int(rng.expovariate(0.5))), None]), rng.randrange(4)) for i in range(3000)]
    files, rules, want = Counter(), Counter(), []
    for i, project, path, rule, priority in sorted(rows, key=lambda r: (r[1], r[4], r[0])):
        if files[project, path] < quotas[0] and rules[project, rule] < quotas[1]:
            files[project, path] += 1
            rules[project, rule] += 1
            want.append(i)
    table = spark.createDataFrame([(i, p, f, r, n, i) for i, p, f, r, n in rows], "id int, project string, path string, rule_id string, priority int, ord int")
    found = t.within_quotas(table, *quotas)
    assert found.columns == table.columns and sorted(r.id for r in found.collect()) == sorted(want)


@pytest.mark.parametrize("strict", [True, False])
def test_coverage_by_either_end(spark, strict):
    rng = random.Random(7)
    name = lambda: "/".join(rng.choice(["src", "a", "xsrc", "pkg", "é"]) for _ in range(rng.randint(0, 3)))
    path = lambda: f"{name()}/{rng.choice(['__init__.py', 'm.py', 'n.py'])}".lstrip("/")
    files, entries = [path() for _ in range(60)], [(path(), i / 100, i) for i in range(60)]
    files += ["", "lonely.go"]
    entries += [("", 0.9, 900), ("deep/down/m.py", 0.5, 901)]
    rates = {}
    for own in files:
        same = [rate for entry, rate, _ in entries if entry == own]
        ends = [(place, rate) for entry, rate, place in entries if (own.endswith(entry) or entry.endswith(own)) and own.rpartition("/")[2] == entry.rpartition("/")[2]]
        rates[own] = max(same) if same else min(ends)[1] if ends else 0.0 if strict else None
    found = k.match_coverage(spark.createDataFrame([(f, 1) for f in files], "path string, rate int"), spark.createDataFrame(entries, "path string, rate double, ord int"), strict)
    assert sorted(((r.path, r.rate) for r in found.collect()), key=repr) == sorted(((f, rates[f]) for f in files), key=repr)
    none = spark.createDataFrame([], "path string, rate double, ord int")
    assert {r.rate for r in k.match_coverage(spark.createDataFrame([("a.py",)], "path string"), none, strict).collect()} == {1.0 if strict else None}
