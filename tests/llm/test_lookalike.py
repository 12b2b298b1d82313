from docsieve.llm import lookalike as L

CASES = {
    "ｃａｍｅｒａ": "camera", "wa​s": "was", "westbound ": "westbound", "саrѕ": "cars", "РМ": "PM", "oﬃcer": "officer", "vehículo": "vehículo", "floor­;": "floor;", "７9": "79", "ΤΟWΙΝG": "TOWING",
    "𝐉𝐨𝐡𝐧": "John", "Ⅳ": "IV", "ｶﾞｿﾘﾝ": "ガソリン", "hօse": "hose", "ᎳᎪT3R": "WAT3R", "В8643304": "B8643304", "ℓane": "lane", "ѕее": "see", "а РМ": "a PM",
}
FINE = ["camera", "Спасибо", "да,", "Ελένη", "می‌روم", "👨‍👩‍👧", "½", "m²", "№", "Übergang", "traf-", "insura¬", "—", "", "façade", "engi­", "PM", "see", "a", "хор", "ура", "Сара Иванова", "Բարև", "℃", "ℹ️", "™", "①"]


def test_deviating_values(spark):
    rows = [(i, v, "x") for i, v in enumerate([*CASES, *FINE])] + [(0, "ｃａｍｅｒａ", "x"), (98, None, "x")]
    df = spark.createDataFrame(rows, "id int, v string, canonical string")
    forms = L.canonical(df, "v").collect()
    assert len(forms) == len(rows)
    for r in forms:
        assert r.canonical_text == CASES.get(r.v, r.v), r.v
    assert sorted(r.id for r in L.deviating(df, "id", column="v").collect()) == list(range(len(CASES)))


def test_running_text():
    assert L.plain("саrѕ wa​s ｃa Спасибо") == "cars was ca Спасибо"
    assert L.plain("это хор и ура Иванова") == "это хор и ура Иванова"  # beside words of their script
    assert L.plain("the РМ train 𝐉𝐨𝐡𝐧") == "the PM train John"


def test_canonical_member_is_deterministic(spark):
    df = spark.createDataFrame([(1, "é"), (2, "é"), (3, "é"), (4, "è"), (5, "E"), (6, "e")], "id int, v string")
    got = {r.id: r.canonical_text for r in L.canonical(df, "v").collect()}
    assert got == {1: "é", 2: "é", 3: "é", 4: "è", 5: "E", 6: "e"}


def test_empty(spark):
    assert L.deviating(spark.createDataFrame([], "id int, v string"), "id", column="v").count() == 0
