import pytest

from wavelake.llm import licenses as Li


def names(text):
    return {x["license"] for x in Li.scan_text(text)}


@pytest.mark.parametrize("name, wording", Li.TEMPLATES)
def test_a_notice_is_found_whatever_else_the_block_holds(name, wording):
    others = [t for n, t in Li.TEMPLATES if n != name and wording not in t]
    assert name in names("\n".join([*others, "some words between", wording]))
    assert name in names("\n".join([wording, "some words between", *others]))


@pytest.mark.parametrize("name, wording", Li.TEMPLATES)
def test_upper_case_wordings_are_found(name, wording):
    assert name in names("before it\n" + wording.upper() + "\nafter it")
