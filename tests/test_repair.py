"""Repair of wrongly decoded texts."""

import pytest

from sparkgauge.functions import scalars

#: Texts that hold what looks like bytes of UTF-8 and must stay, or that nothing is wrong with.
SOUND = [
    None, "", "plain", "déjà vu, ça va…", "CAFÉ» et «ÉTÉ»", "né…» dit-il", "Spaß« und »ÜBER«", "L’été – à 20 €", "größer als ½", "данные и ещё", "漢字かな交じり文", "😀 fine", "Å»", "São João", "NÃO", "£5 © ®", "naïve “quotes” ™",
]
WHOLE = ["é", "déjà vu, ça va…", "L’été – à 20 €", "“quotes” – it’s", "Größe ½ ©", "данные", "漢字かな", "😀 fine", "ｆｕｌｌ", "naïve São João", "Ελληνικά", "שלום", "žluťoučký kůň", "à l’œuvre"]


def wrong(text: str, windows: bool) -> str:
    """text's UTF-8 read one byte a character."""
    latin = text.encode().decode("latin-1")
    return latin.translate(str.maketrans(scalars.LATIN_1, scalars.WINDOWS_1252)) if windows else latin


def repaired(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    return [r.t for r in df.select("i", scalars.repair_text(df.t, **options).alias("t")).orderBy("i").collect()]


def test_sound_texts_stay(spark):
    assert repaired(spark, SOUND) == SOUND


@pytest.mark.parametrize("windows", [False, True])
def test_damaged_texts_come_back(spark, windows):
    once = [f"before {wrong(t, windows)} after" for t in WHOLE]
    assert repaired(spark, once) == [f"before {t} after" for t in WHOLE]
    twice = [wrong(wrong(t, windows), windows) for t in WHOLE]
    assert repaired(spark, twice) == WHOLE
    assert repaired(spark, twice, passes=1) == [wrong(t, windows) for t in WHOLE]


def test_part_of_a_text_and_long_runs(spark):
    long = "漢字" * 100_000
    mixed = f"é stays, {wrong('é', True)} comes back"
    assert repaired(spark, [mixed, wrong(long, True), "x" * 300_000 + wrong("ü", False)]) == ["é stays, é comes back", long, "x" * 300_000 + "ü"]


def test_white_space(spark):
    df = spark.createDataFrame([("\u00a0 a\u3000\x1c b\n" + wrong("à c", True) + "\u2003",), (None,)], "t string")
    assert [r.t for r in df.select(scalars.clean_text(df.t).alias("t")).collect()] == ["a b à c", None]
