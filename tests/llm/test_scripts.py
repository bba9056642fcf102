"""Clean text in scripts that the entropy floor was not set on."""

import pytest

from codeloom.llm import quality

CLEAN = {
    "greek": "Η Ελλάδα είναι χώρα της νοτιοανατολικής Ευρώπης στο νοτιότερο άκρο της Βαλκανικής χερσονήσου και στην ανατολική Μεσόγειο. Πρωτεύουσα της Ελλάδας και μεγαλύτερη πόλη είναι η Αθήνα. Η χώρα συνορεύει στα βορειοδυτικά με την Αλβανία, στα βόρεια με τη Βόρεια Μακεδονία και τη Βουλγαρία και στα βορειοανατολικά με την Τουρκία. Το έδαφός της καλύπτεται κυρίως από βουνά, με υψηλότερη κορυφή τον Όλυμπο, ενώ οι πεδιάδες της Θεσσαλίας παράγουν σιτάρι, βαμβάκι και λάδι. Οι κάτοικοι των νησιών ζουν από την αλιεία, τη ναυτιλία και τον τουρισμό.",
    "cyrillic": "Монгол улс нь Төв Азид оршдог далайд гарцгүй орон юм. Хойд талаараа Орос улстай, бусад талаараа Хятад улстай хиллэдэг. Нийслэл хот нь Улаанбаатар бөгөөд хүн амын бараг тал нь тэнд амьдардаг. Монголчууд эрт үеэс мал аж ахуй эрхэлж, таван хошуу малаа дагаж нүүдэллэн амьдарч ирсэн билээ. Нутгийн өмнөд хэсэгт говь цөл, хойд хэсэгт ой тайга, баруун хэсэгт өндөр уулс оршдог. Зун нь богино, өвөл нь урт бөгөөд маш хүйтэн байдаг учир гэр нь хүмүүст дулаан хоргодох газар болдог.",
}


@pytest.mark.parametrize("script", sorted(CLEAN))
def test_clean_text_is_kept(script):
    of = quality.judge(quality.FertilityRules())
    assert quality.script_of(CLEAN[script]) == script and of(CLEAN[script], None)[-1] is None


def test_greek_junk_and_text_without_letters_still_have_a_floor():
    of = quality.judge(quality.FertilityRules())
    words = ["αβ" * k + c for k in range(1, 30) for c in ("", "α", "β", "αα", "ββ")]
    assert of(" ".join(words), None)[-1] is not None
    assert quality.script_of("## $$ 12") == "none" and quality.FertilityRules().scripts["none"].entropy_shift == -3.0
