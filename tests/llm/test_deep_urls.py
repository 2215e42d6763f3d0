"""Paths that differ from the fifth segment on, against a plain tree."""

import math
import random

from tidemill.llm import urls


def slow_templates(shapes):
    """{(host, shape): template} of {(host, shape): (n, labelled, bad)}, every level of every path."""
    path = {k: k[1].split("/")[1:] for k in shapes}
    for level in range(max(map(len, path.values()))):
        nodes = {}
        for k, p in path.items():
            if len(p) > level:
                child = nodes.setdefault((k[0], *p[:level]), {}).setdefault(p[level], [0, 0, 0])
                for i in range(3):
                    child[i] += shapes[k][i]
        for k, p in path.items():
            if len(p) > level and p[level] != "?":
                kids = nodes[(k[0], *p[:level])]
                all_n, all_l, all_b = (sum(c[i] for c in kids.values()) for i in range(3))
                _, l, b = map(float, kids[p[level]])
                spread, gap = l * (all_l - l) * all_b * (all_l - all_b), b * (all_l - l) - (all_b - b) * l
                variable = len(kids) >= urls.CHILDREN and max(c[0] for c in kids.values()) * len(kids) <= urls.STANDS_OUT * all_n
                bound = urls.Z2 + (2 * math.log(len(kids)) if variable else 0)
                if len(kids) > 1 and (spread == 0 or gap * gap * all_l < bound * spread):
                    path[k] = [*p[:level], "?", *p[level + 1 :]]
    return {k: "/" + "/".join(p) if p else "" for k, p in path.items()}


def test_deep_branches_have_their_own_verdicts(spark):
    pages = [(i, f"http://x.info/a/b/c/d/{'spam' if i < 40 else 'news'}/{i}") for i in range(80)]
    pages += [(100 + i, f"http://y.info/{'/'.join(['p'] * 300)}/{'spam' if i < 40 else 'news'}/{i}") for i in range(80)]
    labels = spark.createDataFrame([(i, i < 40) for i in range(80)], "number long, bad boolean")
    found = urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), labels).collect()
    assert {r.page_id: r.verdict for r in found} == {i: "block" if i % 100 < 40 else "allow" for i, _ in pages}
    assert {r.template for r in found if r.page_id < 80} == {"/a/b/c/d/spam/?", "/a/b/c/d/news/?"}


def test_templates_against_a_plain_tree(spark):
    rng, shapes = random.Random(4), {}
    for _ in range(400):
        depth = rng.randint(0, 9)
        shape = "".join("/" + rng.choice(["a", "b", "c", "?", "", f"v{rng.randrange(40)}"][: rng.choice([2, 5, 6])]) for _ in range(depth))
        labelled = rng.choice([0, 0, 30])
        bad = 0 if not labelled else (25 if "/a/b" in shape else 3)
        shapes[rng.choice(["h", "g"]), shape] = (rng.randint(max(1, labelled), 60) if labelled else 1, labelled, bad)
    rows = [(*k, *v) for k, v in shapes.items()]
    found = urls.templates(spark.createDataFrame(rows, "host string, shape string, n long, labelled long, bad long")).collect()
    assert len(found) == len(rows) and all(math.isfinite(r.n) for r in found)
    assert {(r.host, r.shape): r.template for r in found} == slow_templates(shapes)


def pages_of(spark, copies):
    """A site of 40 sections and as many word ids in each, a fifth of the sections bad, with a literal star in one; labels of its first pages."""
    rng, pages, labels = random.Random(8), [], []
    for k in range(40 * 40 * copies):
        section, name = k % 40, f"slug{chr(97 + k // 40 % 26)}{chr(97 + k // 1040 % 26)}"
        pages.append((k, f"http://z.info/{'*' if section == 5 else f's{chr(97 + section % 26)}{section // 26 * "x"}'}/{name}/{k}"))
        if k < 1600 and rng.random() < 0.3:
            labels.append((k, section % 5 == 0))
    return spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "number long, bad boolean")


def test_more_pages_of_the_same_kinds_make_the_same_tree(spark):
    found = []
    for copies in (1, 6):
        rows = urls.filter_urls(*pages_of(spark, copies)).collect()
        assert all((r.verdict == "block") == (r.page_id % 40 % 5 == 0) for r in rows)
        found.append({r.template for r in rows})
    assert found[0] == found[1] and all(t.endswith("/?/?") for t in found[0]) and any("*" in t for t in found[0])


def test_a_long_number_is_no_other_page(spark):
    pages = spark.createDataFrame([(1, "http://a.b/1000000000000000007"), (2, "http://a.b/7")], "page_id long, url string")
    labels = spark.createDataFrame([(7, True)] * 40 + [(0, True)] * 40, "number long, bad boolean")
    assert {r.verdict for r in urls.filter_urls(pages, labels).collect()} == {"block"}  # one template
    other = spark.createDataFrame([(1, "http://a.b/x/1000000000000000007"), (2, "http://a.b/y/z/8")], "page_id long, url string")
    assert {r.verdict for r in urls.filter_urls(other, labels).collect()} == {"allow"}
