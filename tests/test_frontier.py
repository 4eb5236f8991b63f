from inkspan.operators import frontier
from inkspan.plans import catalog

SF = "/root/testdata/sf0.001"


def plain_closure(edges, roots):
    found = {}
    for root in roots:
        level, at = {root}, 0
        while level:
            found |= {(root, n): at for n in level}
            level, at = {c for n in level for c in edges.get(n, ())} - {n for r, n in found if r == root}, at + 1
    return found


def test_long_chains_and_cycles_are_followed_to_the_end(spark):
    pairs = [(i, i + 1) for i in range(25)] + [(25, 3), (7, 7)]
    edges = {}
    for a, b in pairs:
        edges.setdefault(a, set()).add(b)
    start = spark.createDataFrame([(0,), (24,)], "root long")
    found = frontier.expand(spark.createDataFrame(pairs, "parent long, child long"), start)
    assert {(r.root, r.node): r.depth for r in found.collect()} == plain_closure(edges, [0, 24])


def test_whole_closure_matches_brute_force(spark):
    docs, edges = [r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()], {}
    for d in docs:
        edges[d] = {d * 3 % 200, (d * 5 + 1) % 200}
    found = catalog.queries()["include_closure_whole"](spark, SF).collect()
    assert {(r.root, r.node): r.depth for r in found} == plain_closure(edges, edges) and len(found) == len({(r.root, r.node) for r in found})
    assert max(r.depth for r in found) > 6


def test_includes_are_resolved_beside_the_file_and_from_the_top(spark):
    files = [
        (1, "main.tex", "\\input {parts/a} \\include{missing} \\input{./b.tex}"), (1, "parts/a.tex", "\\input{c} \\input{../b} \\input{parts/d}"), (1, "parts/c.tex", "\\input{main}"),
        (1, "c.tex", ""), (1, "b.tex", None), (1, "parts/d.tex", "\\input{e}"), (1, "e.tex", ""), (2, "main.tex", "\\input{c}"), (2, "parts/c.tex", ""),
    ]
    files += [(3, f"f{i}.tex", f"\\input{{f{i + 1}}}") for i in range(31)]
    found = frontier.included_files(
        spark.createDataFrame(files, "project long, path string, text string"), spark.createDataFrame([(1, "main.tex"), (2, "main.tex"), (3, "f0.tex")], "project long, path string")
    ).collect()
    paths = {p: {(r.path, r.depth) for r in found if r.project == p} for p in (1, 2, 3)}
    assert paths[1] == {("parts/a.tex", 1), ("b.tex", 1), ("parts/c.tex", 2), ("parts/d.tex", 2), ("e.tex", 3)} and not paths[2]
    assert paths[3] == {(f"f{i}.tex", i) for i in range(1, 31)}


def test_roots_that_nothing_leads_to_take_no_part_in_the_rounds(spark, monkeypatch):
    edges = [(1, 2), (2, 3), (3, 2), (9, 1), (8, 3), (7, 7)]
    seen = []
    whole = frontier._rounds
    monkeypatch.setattr(frontier, "_rounds", lambda steps, roots, depth: (seen.extend(r.root for r in roots.collect()), whole(steps, roots, depth))[1])
    made, start = spark.createDataFrame(edges, "parent int, child int"), spark.createDataFrame([(9,), (8,), (7,), (2,), (5,)], "root int")
    for depth in (None, 1):
        found = sorted(tuple(r) for r in frontier.expand(made, start, depth).collect())
        wanted = [(2, 2, 0), (2, 3, 1), (5, 5, 0), (7, 7, 0), (8, 2, 2), (8, 3, 1), (8, 8, 0), (9, 1, 1), (9, 2, 2), (9, 3, 3), (9, 9, 0)]
        assert found == [w for w in wanted if depth is None or w[2] <= depth]
    assert not {8, 9, 5} & set(seen)
