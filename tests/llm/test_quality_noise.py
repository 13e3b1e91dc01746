"""Encoded data planted in short, long and mixed documents, against the prose of the test tables."""

import base64
import random
import re

import pytest
import zstandard

from cairn.llm import quality
from cairn.llm.quality import compression_verdict, quality_rules

SF = "/root/testdata/sf0.01"


def lines(raw: bytes) -> str:
    return "\n".join(re.findall(".{1,76}", raw.decode()))


@pytest.fixture(scope="module")
def prose(spark):
    kept = quality_rules(spark.read.parquet(f"{SF}/documents.parquet")).where("kept and n_dup_lines = 0 and n_repeat_words = 0").orderBy("doc_id").collect()
    return "\n".join(r.text for r in kept)


def verdicts(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    return [r.kept for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()]


def test_encoded_data_is_rejected(spark, prose):
    noise = random.Random(7).randbytes(100_000)
    b64, hexed = lines(base64.b64encode(noise)), lines(noise.hex().encode())
    alone = [x[:n] for x in (b64, hexed) for n in (1000, 1200, 1500, 2048, 3000, 20_000)]
    mixed = [prose[: int(n * (1 - share))] + "\n" + x[: int(n * share)] for x in (b64, hexed) for n, share in ((20_000, 0.6), (60_000, 0.5), (20_000, 0.25), (3000, 0.5))]
    tail = [prose[:2048] + x[:1500] for x in (b64, hexed)]
    assert not any(verdicts(spark, alone + mixed + tail))


def test_prose_is_kept(spark, prose):
    assert len(prose) > 200_000
    assert all(verdicts(spark, [prose[at : at + n] for n in (300, 700, 1500, 2500, 5000, 20_000, 60_000) for at in range(0, 140_000, 23_456)]))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    # whatever has no repetition and enough words stays
    plain = quality_rules(docs).where("not base_failed and n_dup_lines = 0 and n_repeat_words = 0")
    assert plain.where("not kept").count() == 0


# Prose in scripts of two and three bytes a character, written for this test.
PROSE = {
    "ru": "Когда я проснулся, солнце уже стояло высоко, и в комнате было тепло. Мать давно ушла на работу, оставив на столе записку и кусок хлеба. Я долго сидел у окна, глядя на улицу, по которой медленно шли люди, и думал о том, что скажу учителю. Вчера он спросил меня, почему я не читаю книг, и я не знал, что ответить. Теперь мне казалось, что ответ был простой: в нашем доме их не было. Отец считал, что чтение портит глаза, а бабушка говорила, что от книг люди становятся грустными. Но я всё равно хотел узнать, о чём там пишут. В библиотеке на соседней улице работала старая женщина, которая всегда улыбалась детям и никогда не спрашивала, есть ли у них деньги.",
    "el": "Το πρωί ο ήλιος έμπαινε από το παράθυρο και φώτιζε το παλιό τραπέζι της κουζίνας. Η γιαγιά έφτιαχνε καφέ και μας έλεγε ιστορίες για τα χρόνια που ήταν νέα και ζούσε στο νησί. Τότε, έλεγε, οι άνθρωποι δεν είχαν πολλά, αλλά μοιράζονταν τα πάντα. Όταν κάποιος αρρώσταινε, όλο το χωριό πήγαινε να τον δει. Τα παιδιά έπαιζαν στην πλατεία μέχρι αργά το βράδυ και κανείς δεν φοβόταν. Εμείς ακούγαμε σιωπηλοί και προσπαθούσαμε να φανταστούμε τη ζωή χωρίς τηλέφωνα και αυτοκίνητα. Κάθε φορά η ιστορία άλλαζε λίγο, αλλά δεν μας πείραζε καθόλου.",
    "zh": "早上我醒来的时候，太阳已经升得很高了，房间里很暖和。母亲早就去上班了，在桌子上留了一张纸条和一块面包。我坐在窗边看了很久，看着街上慢慢走过的人们，想着该怎么对老师说。昨天他问我为什么不读书，我不知道怎么回答。现在我觉得答案很简单：我们家里没有书。父亲认为读书会伤眼睛，奶奶说书会让人变得忧伤。但是我还是想知道书里写了些什么。隔壁街的图书馆里有一位老妇人，她总是对孩子们微笑，从来不问他们有没有钱。那天下午我鼓起勇气走了进去，里面很安静，空气里有旧纸的味道。她递给我一本薄薄的小说，说这是她小时候最喜欢的故事。",
    "hi": "सुबह जब मेरी नींद खुली तो सूरज काफी ऊपर चढ़ चुका था और कमरे में गर्मी थी। माँ बहुत पहले काम पर चली गई थीं और मेज पर एक चिट्ठी और रोटी का एक टुकड़ा छोड़ गई थीं। मैं देर तक खिड़की के पास बैठा रहा और सड़क पर धीरे धीरे चलते लोगों को देखता रहा। कल अध्यापक ने मुझसे पूछा था कि मैं किताबें क्यों नहीं पढ़ता और मुझे कोई उत्तर नहीं सूझा था। अब मुझे लग रहा था कि उत्तर बहुत सरल है कि हमारे घर में किताबें नहीं थीं। पिताजी मानते थे कि पढ़ने से आँखें खराब होती हैं।",
    "ja": "朝、目が覚めると、太陽はもう高く昇っていて、部屋の中は暖かかった。母はとっくに仕事に出かけていて、テーブルの上に一枚のメモとパンを残していた。私は長い間窓辺に座り、通りをゆっくり歩く人々を眺めながら、先生に何と言おうかと考えていた。昨日、先生はなぜ本を読まないのかと私に尋ねたが、私は何と答えればいいのか分からなかった。今になって、答えは簡単だったように思えた。うちには本がなかったのだ。父は読書は目に悪いと考えていたし、祖母は本を読むと人は悲しくなると言っていた。",
}


@pytest.mark.parametrize("name", sorted(PROSE))
def test_prose_of_other_scripts_is_kept(name):
    packer = zstandard.ZstdCompressor(level=quality.LEVEL)
    text = PROSE[name]
    parts = [text, text[: len(text) // 2], text[len(text) // 3 :], text[:90], text + "\n" + text[::-1], f"Title\n{text}\nhttp://example.org"]
    assert all(compression_verdict(t.encode(), packer)[1] for t in parts)
    # noise beside it, and repetition, are not
    noise = lines(base64.b64encode(random.Random(3).randbytes(6000)))
    assert not compression_verdict((text + "\n" + noise).encode(), packer)[1]
    assert not compression_verdict((text * 12).encode(), packer)[1]


def test_parts_that_repeat_are_rejected(prose):
    packer = zstandard.ZstdCompressor(level=quality.LEVEL)
    assert not compression_verdict((prose[:41_000] + "xyz" * 12_700).encode(), packer)[1]
    assert not compression_verdict((prose[:2048] + "so it is and so it was " * 60).encode(), packer)[1]


def test_columns_of_any_case_are_replaced(spark):
    rows = spark.createDataFrame([(1, "a b c", "own", "own")], "doc_id long, text string, Kept string, RATIO string")
    assert sorted(c.lower() for c in quality_rules(rows).columns) == sorted({c.lower() for c in quality_rules(rows).columns})
