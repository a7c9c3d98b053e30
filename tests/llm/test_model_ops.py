"""Consensus labels and the abuse classifier."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamarisk.llm import abuse, consensus

R = "seq bigint, item_id string, annotator_id string, answer string"


def crowd(n_items=400, seed=1):
    """Answers with known truth: good, mediocre, constant and inverted annotators."""
    rng = random.Random(seed)
    labels = consensus.LABELS
    people = {f"good{k}": 0.93 for k in range(6)} | {f"mid{k}": 0.7 for k in range(3)} | {"same": None, "swap": -1}
    truth, rows = {}, []
    for k in range(n_items):
        t = truth[f"i{k}"] = rng.choices(labels, [5, 4, 1])[0]
        for who in rng.sample(sorted(people), 5):
            q = people[who]
            if q is None:
                said = labels[0]
            elif q == -1:
                said = {labels[0]: labels[1], labels[1]: labels[0]}.get(t, t)
            else:
                said = t if rng.random() < q else rng.choice([x for x in labels if x != t])
            rows.append((len(rows), f"i{k}", who, said))
    return truth, rows


def test_consensus_beats_the_majority(spark):
    truth, rows = crowd()
    items, people = consensus.estimate(spark.createDataFrame(rows, R))
    got = {r.item_id: r for r in items.collect()}
    votes = {}
    for _, i, _, a in rows:
        votes.setdefault(i, []).append(a)
    majority = np.mean([max(sorted(set(v)), key=v.count) == truth[i] for i, v in votes.items()])
    right = np.mean([got[i].answer == t for i, t in truth.items()])
    assert right > 0.95 and right > majority + 0.04
    quality = {r.annotator_id: r for r in people.collect()}
    assert min(quality[f"good{k}"].reliability for k in range(6)) > max(quality[f"mid{k}"].reliability for k in range(3)) > quality["swap"].reliability
    assert all(0 <= r.agreement <= 1 and r.n_annotators == 5 for r in got.values())
    assert all(q.error_bound >= 1 - q.reliability - 1e-9 or q.error_bound == 1 for q in quality.values())


def test_consensus_ignores_order_and_repeats(spark):
    _, rows = crowd(60)
    again = rows + rows[:40]
    random.Random(3).shuffle(again)
    one = {r.item_id: (r.answer, round(r.confidence, 6)) for r in consensus.estimate(spark.createDataFrame(rows, R))[0].collect()}
    two = {r.item_id: (r.answer, round(r.confidence, 6)) for r in consensus.estimate(spark.createDataFrame(again, R).repartition(7))[0].collect()}
    assert one == two


def test_votes_follow_the_rules(spark):
    data = [(1, "i", "A", "applicant"), (5, "i", "A", " Non-Applicant "), (7, "i", "A", "skip"), (2, "i", "B", "NON  APPLICANT"), (3, "i", "C", None), (4, None, "C", "unclear"), (6, "i", None, "unclear"), (None, "j", "A", "unclear"), (8, "j", "A", "Unclear ")]
    df = spark.createDataFrame(data, R).withColumn("label", F.lit("clash")).withColumn("n", F.lit("clash"))
    got = {(r.item_id, r.annotator_id): r.label for r in consensus.votes(df).collect()}
    assert got == {("i", "A"): 1, ("i", "B"): 1, ("j", "A"): 2}
    items, people = consensus.estimate(df)
    assert {r.item_id: (r.answer, r.n_annotators) for r in items.collect()} == {"i": ("non_applicant", 2), "j": ("unclear", 1)}
    items, people = consensus.estimate(df.where("false"))
    assert items.count() == people.count() == 0


def test_broadcast_and_shuffle_agree(spark, monkeypatch):
    _, rows = crowd(50)
    df = spark.createDataFrame(rows, R)
    one = sorted((r.item_id, r.answer) for r in consensus.estimate(df)[0].collect())
    from tamarisk import session

    monkeypatch.setattr(consensus, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(session, "HOT_ROWS", 5)
    items, people = consensus.estimate(df)
    assert sorted((r.item_id, r.answer) for r in items.collect()) == one and people.count() == 11


def test_plain_truth_discovery(spark):
    """One error variance each: better than votes, worse than with confusion counts."""
    truth, rows = crowd()
    right = {}
    for confusion in (False, True):
        items, people = consensus.estimate(spark.createDataFrame(rows, R), confusion=confusion)
        right[confusion] = np.mean([r.answer == truth[r.item_id] for r in items.collect()])
        quality = {r.annotator_id: r for r in people.collect()}
        assert min(quality[f"good{k}"].weight for k in range(6)) > quality["swap"].weight or confusion
    assert 0.85 < right[False] < right[True]


def test_few_answers_weigh_less(spark):
    """Of two annotators who are always right, the one with fewer answers has the wider bound."""
    rows = [(k, f"i{k // 4}", f"a{k % 4}", "applicant" if k // 4 % 2 else "unclear") for k in range(400)]
    rows += [(1000 + k, f"i{k}", "rare", "applicant" if k % 2 else "unclear") for k in range(3)]
    rows += [(2000 + k, f"i{k}", "noise", ("applicant", "unclear", "non_applicant")[k % 3]) for k in range(100)]
    for confusion in (False, True):
        q = {r.annotator_id: r for r in consensus.estimate(spark.createDataFrame(rows, R), confusion=confusion)[1].collect()}
        assert q["rare"].weight < q["a0"].weight and (q["rare"].error_bound > q["a0"].error_bound or not confusion)


@pytest.mark.parametrize("p, n, want", [(0.025, 1, 0.000982), (0.025, 10, 3.24697), (0.5, 4, 3.35669), (0.025, 100, 74.2219), (0.025, 1000, 914.257), (0.975, 30, 46.9792)])
def test_chi_squared_quantiles(p, n, want):
    assert consensus.chi2_quantile(p, n) == pytest.approx(want, rel=2e-4)


@pytest.fixture(scope="module")
def model():
    return abuse.trained()


def test_held_out_fillings(model):
    """Other names, places, groups, insults and disguises than in training."""
    texts, labels, _ = abuse.samples(copies=6, seed=99)
    seen = set(abuse.samples()[0])
    new = [(t, y) for t, y in zip(texts, labels) if t not in seen]
    wrong = np.mean([(model.probability(t) >= abuse.THRESHOLD) != bool(y) for t, y in new])
    assert len(new) > 1000 and wrong < 0.02


#: Written apart from the labelled sentences, in other words and styles.
HELD_OUT_ABUSE = """
She is a dirty whore
You're an absolute waste of space, dickhead
They ought to string up every last one of those immigrants
Oh do shut your ugly mouth, you pathetic little worm
Whoever hired this moron should be ashamed, what a dumb pig
I'll smash that stupid face of yours, just wait
One more word and my boys will burn your car
Women are too stupid for this, keep them in the kitchen
Muslims are a plague and should be thrown out
Foreigners? Filthy rats, all of them. Kick them out.
Want a raise, honey? Then come to bed with me
He asked for nude selfies before he would sign anything
Sit on my lap and show me your breasts, then we talk about salary
Go kill yourself, nobody needs a loser like you
You fucking idiot, eat shit and die
أنت حيوان وقذر ولا تستحق الاحترام
اخرس أيها الكلب الحقير
والله لأكسر عظامك يا حقير
اللاجئون لصوص وحثالة ويجب طردهم
النساء غبيات ومكانهن المطبخ
نامي معي وأعطيك الوظيفة
أرسلي صورا عارية لجسمك
سوف أقتلك أنت وأولادك
Ferme-la, sale pute, tu es une ordure
Les arabes sont des rats, dehors les parasites
Je vais te casser les dents, connard
Заткнись, тупая скотина
Мигранты — крысы и воры, гнать их
Я тебя убью, тварь
闭嘴，你这个蠢货
外国人都是垃圾和小偷
你跟我睡一晚，工作就给你
چپ کر کمینے کتے
मार डालूँगा तुझे, हरामी
黙れ、役立たずのクズ
女は馬鹿だ、雇うな
ไสหัวไป ไอ้โง่
ዝም በል አንተ ቆሻሻ ውሻ
"""
HELD_OUT_SOBER = """
We hired many immigrants this year.
Our team includes women, immigrants and Muslims
Our team includes men, locals and Christians
The disabled have reserved parking.
Women and men earn the same salary here.
Old people need more care in winter.
Gay people live next door.
She teaches refugees every evening.
Jews, Muslims and Christians share the building.
The black workers formed a union.
Several blind people swim here on Fridays.
The parliament debated the rights of refugees and women.
Teenagers must be accompanied by their parents.
The library lends novels about gangs and crime.
Please forward the invoice to the accounts desk.
Two electricians and a roofer wanted for a school building
The course covers contraception, pregnancy and birth.
Her thesis compares insults in three dialects.
The kennel feeds forty dogs a day.
My previous employer closed and I moved.
Do you offer remote work on Wednesdays?
The witness described the stabbing to the police.
Remove the naked cable and insulate it.
اللاجئون والنساء مرحب بهم في مركزنا
تناقش الندوة حقوق المهاجرين
يحتاج كبار السن إلى رعاية في الشتاء
نبحث عن كهربائي لبناء مدرسة
أين يقع المكتب ومتى يفتح؟
عيادة الأسنان تفتح يوم السبت
Les femmes et les étrangers ont les mêmes droits
Le colis arrive mercredi
Беженцы и женщины посещают курсы
Поезд отправляется вечером
老人和移民都可以参加课程
图书馆星期三开门
خواتین اور مہاجر کورس میں آ سکتے ہیں
महिलाएँ और शरणार्थी कोर्स में आ सकते हैं
外国人と老人も参加できます
คนพิการและผู้หญิงเข้าร่วมได้
ሴቶችና ስደተኞች መሳተፍ ይችላሉ
"""


def test_held_out_sentences(model):
    lines = lambda x: x.strip().split("\n")
    caught = [t for t in lines(HELD_OUT_ABUSE) if model.probability(t) >= abuse.THRESHOLD]
    false = [t for t in lines(HELD_OUT_SOBER) if model.probability(t) >= abuse.THRESHOLD]
    print(len(caught), len(lines(HELD_OUT_ABUSE)), false)
    assert len(caught) >= 0.9 * len(lines(HELD_OUT_ABUSE)), set(lines(HELD_OUT_ABUSE)) - set(caught)
    assert len(false) <= 0.1 * len(lines(HELD_OUT_SOBER)), false
    assert not set(false) & set(lines(HELD_OUT_SOBER)[:10])  # neutral mentions of groups


def test_held_out_templates(monkeypatch):
    """Sentences of whole templates kept out of training."""
    rng = random.Random(5)
    out = {k: [t for t in x.strip().split("\n") if t] for k, x in (("ABUSIVE", abuse.ABUSIVE), ("NEUTRAL", abuse.NEUTRAL))}
    held = {k: set(rng.sample(v, len(v) // 6)) for k, v in out.items()}
    for k, v in out.items():
        monkeypatch.setattr(abuse, k, "\n".join(t for t in v if t not in held[k]))
    m = abuse.fit(*abuse.samples())
    rate = lambda k: np.mean([m.probability(abuse._fill(t, rng)) >= abuse.THRESHOLD for t in sorted(held[k]) for _ in range(5)])
    caught, false = rate("ABUSIVE"), rate("NEUTRAL")
    print(caught, false)
    assert caught > 0.8 and false < 0.45, (caught, false)


def test_the_swap_penalty_brings_groups_together():
    """Scores of copies with swapped groups are closer with the penalty than without."""
    s = abuse.samples(copies=6)
    gaps = []
    for penalty in (0.0, 0.5):
        m = abuse.fit(*s, swap_penalty=penalty)
        gaps.append(np.mean([abs(m.score(abuse.passages(f"{a} live in our street")[0]) - m.score(abuse.passages(f"{b} live in our street")[0])) for a in abuse.SLOTS["group"] for b in ("people", "women", "Jews")]))
    assert gaps[1] < 0.6 * gaps[0], gaps


def test_background_teaches_what_is_ordinary():
    """Words unknown to the labels, common in a corpus; a rare abusive passage in it is no lesson."""
    rng = random.Random(1)
    odd = ["zorp {} idiot-free flanges", "the {} moron valve is oiled", "stupid {} bolts are fine"]
    texts = [f"{rng.choice(odd).format(rng.choice('abcdefgh') * 3)}. item {k}" for k in range(300)] + ["You stupid moron, go to hell."]
    plain, m = abuse.trained(), abuse.fit(*abuse.samples(), background=texts)
    probe = ["zorp kkk idiot-free flanges", "the xyz moron valve is oiled"]
    assert all(m.probability(t) < min(abuse.THRESHOLD, plain.probability(t)) for t in probe)
    assert m.probability("You stupid moron, go to hell.") > abuse.THRESHOLD


def test_adapting_to_a_table(spark):
    texts = [(k % 40, f"note {k % 40}. the lamp is on") for k in range(400)] + [(1000, None), (1001, "")]
    df = spark.createDataFrame(texts, "doc_id int, text string")
    assert abuse.adapted(df) is abuse.adapted(df.repartition(7)) and abuse.adapted(df, texts=5) is abuse.adapted(df.repartition(3), texts=5)
    assert abuse.adapted(df.where("false")) is abuse.trained()
    long = df.union(spark.createDataFrame([(k, "calm words. " * 50_000 + str(k)) for k in range(3)], "doc_id int, text string"))
    assert abuse.adapted(long, chars=100) is not None and abuse.adapted(long, chars=0) is abuse.trained()


def test_long_words_are_read_whole(model):
    """No prefix: what stands behind many characters without a blank counts."""
    assert model.probability("今天天气很好" * 20 + "你这个蠢货滚出去" + "今天天气很好" * 20) > abuse.THRESHOLD
    assert model.probability("ok 好的 谢谢, fuck you") > abuse.THRESHOLD  # two Latin words beside another script
    assert len(abuse.passages("xy" * 50_001)) > 4_000


@pytest.mark.parametrize("text", ["You m*ron, leave me alone.", "You  s t u p i d   c o w, leave.", "GO TO HELL, PETER, YOU SCUUUUMBAG.", "Shut up, you l0ser!", "You piece of sh\u200bit, leave me alone.", "You st<b>up</b>id m&#111;ron"])
def test_disguises(model, text):
    assert model.probability(text) > abuse.THRESHOLD


def test_score_table(spark, model):
    calm = "We need a nurse with at least 3 years of work in finance. "
    data = [(1, None), (2, ""), (3, " \n"), (4, "?"), (5, calm * 3000), (6, calm * 3000 + "Shut up, you moron! " + calm), (6, "Shut up, you moron!")]
    df = spark.createDataFrame(data, "doc_id int, text string").withColumn("score", F.lit("clash")).withColumn("source", F.when(F.col("doc_id") < 5, "a"))
    got = abuse.score(df).collect()
    assert len(got) == 7
    assert all((r.score >= abuse.THRESHOLD) == (r.doc_id == 6) for r in got)
    rates = {r.source: (r.n_docs, r.n_flagged) for r in abuse.source_rates(abuse.score(df)).collect()}
    assert rates == {"a": (4, 0), None: (3, 2)}
    assert abuse.score(df.where("false")).count() == 0
