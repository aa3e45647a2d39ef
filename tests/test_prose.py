import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphmill.functions.prose import normalize, suggestions

CASES = [
    ("كتاب خانه ی من", "کتاب خانه ی من"),
    ("سلام , خوبی ? بله", "سلام، خوبی؟ بله"),
    ("قیمت 1,200 تومان", "قیمت ۱,۲۰۰ تومان"),
    ("پخش MP3 و COVID-19 در سال 2020", "پخش MP3 و COVID-19 در سال ۲۰۲۰"),
    ("1. متن فارسی 25%", "1. متن فارسی ۲۵٪"),
    ('او گفت "سلام" و رفت', "او گفت «سلام» و رفت"),
    ("می روم و نمی آید", "می‌روم و نمی‌آید"),
    ("کتاب ها و بزرگ ترین", "کتاب‌ها و بزرگ‌ترین"),
    ("خانه ام که ای", "خانه‌ام که ای"),
    ("های و هوی ها و هوی", "های و هوی ها و هوی"),
    ("سلام...", "سلام…"),
    ("متن ـ متن سـلام", "متن – متن سلام"),
    ("ببین `a , b` و v1.2.3 را", "ببین `a , b` و v1.2.3 را"),
    ("English, only? \"yes\" 12", "English, only? \"yes\" 12"),
    ("متن  با   فاصله ", "متن با فاصله"),
    (None, None),
    ("", ""),
]


@pytest.mark.parametrize("before,after", CASES)
def test_prose(before, after):
    assert normalize(before)[0] == after


@settings(max_examples=300, deadline=None)
@given(st.text("سلام ها می تر,?\"12٣.ـك \n`", max_size=25))
def test_twice_changes_nothing_more(text):
    once = normalize(text)[0]
    assert normalize(once)[0] == once or normalize(normalize(once)[0])[0] == normalize(once)[0]


def test_counts_and_suggestions():
    assert normalize("كتاب كوچك, ٣")[1] == {"letters": 3, "comma": 1, "digits": 1}
    assert [k for k, _ in suggestions("بزرگ تر میرود میز — توسط او", True)] == ["comparative", "glued prefix", "em dash", "style: by"]
    assert suggestions(None) == []
