from pyspark.sql import functions as F

from siftline.functions import titles


def classes(ask, rules, names):
    return [r["c"] for r in ask(names, "t string", c=titles.title_class(F.col("t"), rules))]


def test_listed_and_variants(ask, rules):
    listed = ["Kitchen Gardener", "ROSE-GARDENER", "Senior Market Gardener", "Jr. Orchard Keeper", "Rose Gardener/ית",
              "שותלית בוטני", "Head Seed Librarian (Remote)"]
    assert classes(ask, rules, listed) == ["listed"] * len(listed)
    variants = ["Senior Palm Gardening", "Moss Gardener", "שותל-ית ותיק"]
    assert classes(ask, rules, variants) == ["variant"] * len(variants)


def test_excluded_phrases_go_first(ask, rules):
    names = ["Garden Designer", "Irrigation Fitter", "Landscape Surveyor II", "Senior Mower Mechanic", "Tree Feller, Tree Feller"]
    assert classes(ask, rules, names) == ["excluded"] * 5


def test_combined_needs_a_role_word(ask, rules):
    assert classes(ask, rules, ["Irrigation Fitter / Market Gardener", "Tree Feller & Gardener"]) == ["combined"] * 2


def test_candidates(ask, rules):
    assert classes(ask, rules, ["Botany Writer", "Senior Horticulturist", "Soil sampler"]) == ["candidate"] * 3
    # a hint does not help a blocked or hard-stop title; rank words count here
    blocked = ["Head of Botany", "Foreman, Gardens", "Garden Fitter", "Soil Surveyor", "Butcher", "Cook", "", None]
    assert classes(ask, rules, blocked) == [None] * len(blocked)


def test_words_are_unicode_words(ask, rules):
    assert classes(ask, rules, ["אגינהב", "xgardenx"]) == ["candidate", "candidate"]


def test_is_potential(ask, rules):
    out = ask(["Kitchen Gardener", "Tree Feller", "Cook"], "t string",
              p=titles.is_potential(titles.title_class(F.col("t"), rules)))
    assert [r["p"] for r in out] == [True, False, False]
