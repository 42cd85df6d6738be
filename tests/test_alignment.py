"""Alignment: the cases of FIXTURES.md, what earlier mentions change for later ones, and a plain sequential version."""

from dataclasses import replace
from difflib import SequenceMatcher

import pytest

from savora.operators import resolve
from savora.params import Params

P = Params()
MENTIONS = "mid long, city string, name_norm string, address_text string"
SHOPS = "shop_id long, city string, name_norm string, address string, status string, is_chain boolean"
ALIASES = "shop_id long, alias_norm string"


def align(spark, mentions, shops=(), aliases=(), p=P):
    frames = [spark.createDataFrame(list(rows), schema) for rows, schema in ((mentions, MENTIONS), (shops, SHOPS), (aliases, ALIASES))]
    return {r.mid: r for r in resolve.align_in_order(frames[0], frames[1], p, frames[2]).collect()}


def city(*names):
    return [(i + 1, "成都", n, None) for i, n in enumerate(names)]


def test_half_alike_names_are_reviewed_and_others_are_new(spark):
    got = align(spark, city("成都老妈火锅", "成都老妈串串"))
    assert (got[1].action, got[1].shop_id, got[1].new_name) == ("new", -1, "成都老妈火锅")
    assert (got[2].action, got[2].shop_id, got[2].reason) == ("review", -1, "grey zone")
    assert got[2].score == pytest.approx(2 / 3, abs=1e-4)
    assert [r.action for r in align(spark, city("蜀香源火锅", "蜀香源串串")).values()] == ["new", "new"]


def test_a_bare_brand_between_branches_has_multiple_candidates(spark):
    shops = [(1, "成都", "飘香馆一店", None, "active", False), (2, "成都", "飘香馆二店", None, "active", False)]
    got = align(spark, city("飘香馆"), shops)[1]
    assert (got.action, got.reason, got.shop_id) == ("review", "multiple candidates", 1)


@pytest.mark.parametrize(("chain", "other", "reason"), [(False, "别家", "grey zone"), (True, "别家", "branch"), (False, "成都老妈火锅一店", "branch")])
def test_branch_is_read_from_the_candidate_and_its_siblings(spark, chain, other, reason):
    shops = [(1, "成都", "成都老妈火锅", None, "active", chain), (2, "成都", other, None, "active", False)]
    got = align(spark, city("成都老妈串串"), shops)[1]
    assert (got.action, got.shop_id, got.reason) == ("review", 1, reason)


def test_aliases_come_first_and_merged_names_become_aliases(spark):
    shops = [(1, "成都", "明婷饭店", None, "active", False), (2, "成都", "小明婷", None, "active", False), (3, "成都", "旧店", None, "merged", False)]
    got = align(spark, city("小明婷", "旧店", "明婷饭店铺", "明婷饭店铺"), shops, [(1, "小明婷"), (3, "旧店")])
    assert (got[1].action, got[1].shop_id) == ("merge", 1)
    assert got[2].action == "new"
    assert (got[3].shop_id, got[3].score, got[4].shop_id, got[4].score) == (1, 0.9, 1, 1.0)


def test_mentions_without_city_are_skipped(spark):
    assert set(align(spark, [(1, None, "甲乙丙丁", None), (2, "", "甲乙丙丁", None), (3, "成都", "甲乙丙丁", None)])) == {3}
    assert align(spark, []) == {}


def test_an_exact_mention_brings_the_address_that_later_ones_are_scored_by(spark):
    shops = [(1, "成都", "成都老妈火锅", None, "active", False)]
    near, far = (9, "成都", "成都老妈串串", "人民路八号"), (9, "成都", "成都老妈串串", "建设巷")
    brought = (5, "成都", "成都老妈火锅", "人民路八号")
    assert align(spark, [near, brought], shops)[9].score == pytest.approx(0.7 * 2 / 3 + 0.3)
    assert align(spark, [far, brought], shops)[9].action == "new"
    assert align(spark, [(1, *far[1:]), brought], shops)[1].score == pytest.approx(2 / 3)


def plain(mentions, shops, aliases, p):
    """One step for each mention, nothing left out."""
    grams = lambda t: {g for part in [(t or "").replace(" ", "")] if part for g in ({part} if len(part) <= 2 else {part[i : i + 2] for i in range(len(part) - 1)})}
    out = {}
    for c in sorted({m[1] for m in mentions if m[1]}):
        known = [dict(id=s[0], norm=s[2], addr=s[3]) for s in shops if s[1] == c]
        alias = {n: i for i, n in aliases if any(k["id"] == i for k in known)}
        for mid, _, norm, addr in sorted(m for m in mentions if m[1] == c):
            owner = alias.get(norm) or max((k["id"] for k in known if k["norm"] == norm), default=None)
            if owner is None:
                scores = []
                for k in known:
                    name = 0.9 if norm in k["norm"] or k["norm"] in norm else SequenceMatcher(None, norm, k["norm"]).ratio()
                    x, y = grams(addr), grams(k["addr"])
                    scores.append((p.name_weight * name + p.address_weight * len(x & y) / len(x | y)) / (p.name_weight + p.address_weight) if x and y else name)
                top = max(scores, default=0.0)
                ties = [k["id"] for k, s in zip(known, scores) if top > 0 and s >= top - 1e-9]
                if ties and top >= p.match_threshold and len(ties) == 1:
                    owner = alias[norm] = ties[0]
                elif ties and top >= p.review_threshold:
                    out[mid] = ("review", ties[0])
                    continue
                else:
                    known.append(dict(id=-mid, norm=norm, addr=addr))
                    out[mid] = ("new", -mid)
                    continue
            out[mid] = ("merge", owner)
            shop = next(k for k in known if k["id"] == owner)
            shop["addr"] = addr if shop["addr"] is None and addr else shop["addr"]
    return out


def test_against_a_plain_fold(spark):
    letters, p = "abcde", replace(P, name_prefixes=(), name_suffixes=(), branch_words=())
    word = lambda k, n: "".join(letters[(k * 7 + i * i * (k % 5 + 1)) % 5] for i in range(n))
    addresses = [None, "lane1", "lane2", "road9"]
    shops = [(i, f"c{i % 2}", word(i, 3 + i % 4) + str(i), addresses[i % 3], "active", False) for i in range(1, 15)]
    mentions = [(100 + i, f"c{i % 2}", word(i % 40, 3 + i % 5) + str(i % 17), addresses[i % 4]) for i in range(160)]
    aliases = [(2, mentions[6][2]), (3, mentions[7][2])]
    want = plain(mentions, shops, aliases, p)
    got = {k: (r.action, r.shop_id) for k, r in align(spark, mentions, shops, aliases, p).items()}
    assert got == want and {a for a, _ in got.values()} == {"merge", "review", "new"}


def test_fuzzy_decisions_against_all_pairs(spark):
    shops = [(1, "c", "abcd", "lane1", "active", False), (2, "c", "abce", "lane1", "active", False), (3, "c", "xyzw", None, "active", False), (4, "d", "abcd", None, "active", False), (5, "c", "mnop", None, "merged", False)]
    names = [(1, "c", "abcf", "lane1"), (2, "c", "xyzv", "lane1"), (3, "c", "abcd", None), (4, "c", "mnop", None), (5, None, "abcd", None), (6, "c", "abcf", "lane1"), (7, "c", "abcdabcdq", "lane1"), (8, "c", None, None)]
    frame, places = spark.createDataFrame(names, MENTIONS), spark.createDataFrame(shops, SHOPS)
    got = {r.mid: (r.action, r.shop_id, r.reason) for r in resolve.decisions(resolve.fuzzy_matches(frame, places, P), P, frame).collect()}
    two = ("review", 1, "grey zone")
    assert got == {1: two, 2: ("review", 3, "grey zone"), 3: ("merge", 1, None), 4: ("new", None, None), 6: two, 7: ("merge", 1, None), 8: ("new", None, None)}
