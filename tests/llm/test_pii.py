from arborix.llm import personal, pii

CASES = [
    ("Write to ana.b+c@mail.example.org, not to the list.", [("email", "ana.b+c@mail.example.org")]),
    ("mail=X_Y9@LAB.EXAMPLE.NET;scope=all", [("email", "X_Y9@LAB.EXAMPLE.NET")]),
    ("Questions? tree.desk (at) example.com", [("email", "tree.desk (at) example.com")]),
    ("(jo [at] mail [dot] dept-3 [dot] test).", [("email", "jo [at] mail [dot] dept-3 [dot] test")]),
    ("Send it to kim AT annot.invalid please", [("email", "kim AT annot.invalid")]),
    ("Installed as mapper@0.14.2; use @exon, and look at this. At low coverage", []),
    ("Call +1 (312) 555-0188 before noon", [("phone", "+1 (312) 555-0188")]),
    ("電話：+13125550126 x", [("phone", "+13125550126")]),
    ("Tel. (646) 555 0161", [("phone", "(646) 555 0161")]),
    ("fax (0)30 23125-076\nT +49 30 23125 980\n", [("phone", "(0)30 23125-076"), ("phone", "+49 30 23125 980")]),
    ("mobile;0044-20-7946-0576;private", [("phone", "0044-20-7946-0576")]),
    ("phone: 01.99.00.42.03 (mornings)", [("phone", "01.99.00.42.03")]),
    ("Sample 0049-30-9047-3131 failed on plate 30; the interval 555-0112 is empty; build 415-7968", []),
    ("Their SSN 666-25-6630 was pasted; index build 900-15-9321 is withdrawn.", [("id_number", "666-25-6630")]),
    ("(DNI 99999856-W, remove)", [("id_number", "99999856-W")]),
    ("Le numéro NIR 9 68 13 99 156 935 82 doit être effacé", [("id_number", "9 68 13 99 156 935 82")]),
    ("Steuer-ID: 00 088 270 384", [("id_number", "00 088 270 384")]),
    ("Checksum XQ6860117252 differs; Barcode 6880 9485 9342 2768 belongs", []),
    ("Ana\t1\nNils Lindborne\t+49 30 23125 949\t00 859 192 667", [("person_name", "Nils Lindborne"), ("phone", "+49 30 23125 949"), ("id_number", "00 859 192 667")]),
    ("lives at 210B Old Mill Close, flat 21", [("street_address", "210B Old Mill Close")]),
    ("5 OF THEM PLACE IT; 12 units close", []),
    ("Adresse : 166 bis rue des Trois Ponts, Ville", [("street_address", "166 bis rue des Trois Ponts")]),
    ("Address: 29 impasse de l'Abri Identity over the gap", [("street_address", "29 impasse de l'Abri")]),
    ("lives at 53, rue des Trois Ponts, flat 3\nThe old office at 7 avenue du Grand Mur is closed.", [("street_address", "53, rue des Trois Ponts"), ("street_address", "7 avenue du Grand Mur")]),
    ("Return to:\n115 chemin des Dunes\nVilleneuve One", [("street_address", "115 chemin des Dunes")]),
    ("Address: Lerchenweg 110 I moved\nAm Alten Hof 3\n- Please", [("street_address", "Lerchenweg 110"), ("street_address", "Am Alten Hof 3")]),
    ("Steuer-ID: 00 133 752 791 699 bases; fax +33 1 99 00 32 87 14 bases", [("id_number", "00 133 752 791"), ("phone", "+33 1 99 00 32 87")]),
    ("Anschrift: Birkenstraße 47a, Ort", [("street_address", "Birkenstraße 47a")]),
    ("in der Am Alten Hof 12b.", [("street_address", "Am Alten Hof 12b")]),
    ("Dirección: Calle del Huso Azul, 18, 00917", [("street_address", "Calle del Huso Azul, 18")]),
    ("Return to:\n94 Quarry St.\nTown", [("street_address", "94 Quarry St.")]),
    ("Signed, Søren\nFennacker The rest", [("person_name", "Søren\nFennacker")]),
    ("Thanks to Lindström, Y. for the blocks.", [("person_name", "Lindström, Y.")]),
    ("Dr JORIS THORNHOLLOW disagrees with this call.", [("person_name", "JORIS THORNHOLLOW")]),
    ("Merci à M. M. Brandmund pour la relecture.", [("person_name", "M. Brandmund")]),
    ("Cordialement, Greta A. Gralmund", [("person_name", "Greta A. Gralmund")]),
    ("Geprüft von Marlanti, José.", [("person_name", "Marlanti, José")]),
    ("cc G. de la Querosa; no reply yet", [("person_name", "G. de la Querosa")]),
    ("審核 确认 请联系 Kamil O'Fennivar 。", [("person_name", "Kamil O'Fennivar")]),
    ("The Ostervane index and the Greta Brandhollow test agree here.", []),
    ("zofia@x.example and Zofia alone", [("email", "zofia@x.example")]),
    ("", []),
    ("   ", []),
    ("İİ SSN 666-25-6630", [("id_number", "666-25-6630")]),
]


def test_cases():
    for text, want in CASES:
        got = [(k, text[a:b]) for a, b, k in pii.find(text)]
        assert got == want, (text, got)
    assert pii.find(None) == []


def test_redaction_round_trip():
    for text, want in CASES:
        out = pii.redact(text, pii.find(text))
        for kind, value in want:
            assert pii.PLACEHOLDERS[kind] in out
            out = out.replace(pii.PLACEHOLDERS[kind], value, 1)
        assert out == text


def test_long_text_is_linear():
    text = "mail x@y.example " * 20_000 + "a" * 200_000 + "@" * 20_000 + "1 " * 100_000
    assert len(pii.find(text)) == 20_000


def test_rows(spark):
    rows = [(i, t, "c") for i, (t, _) in enumerate(CASES)] + [(500, None, "c"), (501, "Contact: Nils Lindborne and Nils Lindborne", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, pii_type string")
    got = [tuple(r) for r in personal.find(df, "doc_id", "text").collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(i, k, v) for i, (_, want) in enumerate(CASES) for k, v in want} | {(501, "person_name", "Nils Lindborne")}
    red = {r.doc_id: (r.redacted, r.n_found) for r in personal.redact(df, "doc_id", "text").collect()}
    assert red[500] == (None, 0) and red[501] == ("Contact: [PERSON_NAME] and [PERSON_NAME]", 2) and red[next(i for i, (t, _) in enumerate(CASES) if t == "")] == ("", 0)
    assert personal.find(df.limit(0), "doc_id", "text").count() == 0


#: Names that no test table holds; of their given names the lexicon has some.
HELD_OUT = (
    "Petronella Achterberg|Ignatius Obi|Priyanka Desai|Valentin Moreau|Rosalind Hart|Tomoko Endo|Sebastiano Greco|Yevgenia Orlova|Dagmar Vogel|Hyacinth Bell|Mercy Okafor|Kiran Patel|Aurelio Vega|Bertrand Dubois|Solange Petit|"
    "Liesbeth Bakker|Anneli Virtanen|Cormac Doyle|Rhiannon Price|Ludovic Fabre|Tendai Moyo|Zainab Bello|Ravi Menon|Mei Tanaka|Olga Petrova|Henrik Dahl|Sigrid Berg|Carlos Mendes|Laura Conti|Thomas Weber"
).split("|")


def test_held_out_names():
    for before, after in (("The sheet was checked by ", " last week."), ("Dr ", " found the gap."), ("Regards, ", "\n"), ("Thanks to ", " The table is here.")):
        for name in HELD_OUT:
            text = before + name + after
            assert [(k, text[a:b]) for a, b, k in pii.find(text)] == [("person_name", name)], text
    alone = [n for n in HELD_OUT if any(k == "person_name" and t[a:b] == n for t in [f"We met {n} there."] for a, b, k in pii.find(t))]
    assert len(alone) == 8


def test_numbers_of_any_area_and_letters():
    for text, want in [
        ("see 123-45-6789 here", [("id_number", "123-45-6789")]), ("see 078 05 1120 here", [("id_number", "078 05 1120")]), ("see AB 12 34 56 C here", [("id_number", "AB 12 34 56 C")]), ("see CH1234567 here", [("id_number", "CH1234567")]),
        ("see 123-00-6789, 123-45-0000 and accession AB1234567", []), ("see 312-867-5309 here", [("phone", "312-867-5309")]), ("see 415.867.5309 here", [("phone", "415.867.5309")]), ("see 911-867-5309 and 312-911-5309 and v1.312-867-5309", []),
    ]:
        assert [(k, text[a:b]) for a, b, k in pii.find(text)] == want, text
