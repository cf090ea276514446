"""Personal information: forms of each kind, what is none, pseudonyms, and odd inputs."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm import personal as P

FOUND = {
    "email": ["write to bao.esk+x@eu.mail.example now", "ELISE+O@POSTFERN.EXAMPLE", "a <noor@x.test>", "jonas [at] x.test", "rosa (at) mail.example", "wen(a)x.invalid", "novak90 AT mail.qm", "mira+c at mail dot xa", "aoife dot pell at x dot example", "emre&#64;x.test", "srose＠mail.example", "mailto:a.b@c.example"],
    "phone": ["tel. +44 1632 960822", "01632 960 948", "On-call: (655) 555-0139 x59", "Call 555-0179 after", "+33 1 99 00 22 34 (mobile)", "01.99.00.65.92 ext. 00", "+34 600 000 570", "+91 55555 03264", "0049302312 5307", "030/23125-805", "+1 (555) 012-0344", "+44\u00a01632\u00a0960153"],
    "id_number": ["SSN 966 87 4963", "row has 975-76-7873 in it", "DNI 29787068G", "driver licence B745828KA", "passport no. PF1754502", "паспорт 3157 002904", "Personalausweis N71943954", "Steuer-ID 74 968 762 085", "national id: 0032-6263-9953", "tax number 657/7915/6209", "n° de sécurité sociale 1 62 05 99 066 532"],
    "address": ["191 Old Ferry Blvd, Apt 18, Brindleford 64374", "Flat 11, Mill House, Tanglewood Street, Kestrel Bay", "P.O. Box 1250, Kestrel Bay 36228", "Mühlenstr. 108, 32144 Vennby", "Alte Gasse 37, 52435 Aubervale", "88 rue des Tanneurs, 29286 Port Halvard", "Calle del Molino, 185, 2.º B, 95468 Port Halvard", "ул. Заречная, д. 195, кв. 3, г. Вельмск", "148 Tanglewood Ct, Port Halvard", "115 bis rue de l'Étang, 66268 X", "Am Wehr 197, 17570 Brindleford"],
    "name": ["Ask D. Stankontane before touching this.", "Owner: renata ombolun", "@author Pellvell, Oskar", "Signed-off-by: C. Jessamor", "created_by=Tiago J. van den Tarevo status=ok", "[10:42] 沈砚秋: can someone look", "Voir avec ULLA BRINDRAND pour les accès.", "Thanks to Ms. Marchquin for the report.", "| reviewer | Зоя Ильварова |", "meeting notes (oskar domland, remote)", "Chiara A. Jessovar left the team in March"],
}
NONE = [
    "Clone it with git@code.harbor.example:core/token.git first.", '@app.route("/route/52")', "Install @lumen/digest@2.35.1 from the mirror.", "Use the form <name>@<domain> for all accounts.", "sku 9780-31-4441-2 is sold out", "Order 4412-33-9031 was closed.", "Ticket numbers look like 555-45-000-1.",
    "The node answers on 10.0.18.14:8080 only.", "Build 2024.06.53 replaced build 2024.05.11.", "The Baker Street theme was dropped.", "Signed-off-by: release bot", "About 7700 counters leave Kestborneix behind the proxy.", "postgres://svc:secret@db.example:99/x", "Deploys happen at 10 past every hour.", "version 1.2.3 of the tool, 2024-05-01", "", "Ask the platform team before touching this.",
]


@pytest.mark.parametrize("kind,line", [(k, x) for k, v in FOUND.items() for x in v])
def test_found(kind, line):
    text = f"first line\n{line}\nlast"
    got = {(n, m.kind) for n, m in P.mentions(text)}
    assert (2, kind) in got and {n for n, _ in got} == {2}


@pytest.mark.parametrize("line", NONE)
def test_none(line):
    assert list(P.mentions(line)) == []


def test_a_name_inside_an_address_is_no_name():
    assert {m.kind for _, m in P.mentions("write to oskar.hallmann@mail.example please")} == {"email"}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="0123456789ABCabc -+()/.", min_size=1, max_size=24), st.binary(min_size=1, max_size=32))
def test_pseudonyms_keep_the_format_and_can_be_undone(value, key):
    made = P.pseudonym(value, key)
    shape = lambda v: re.sub(r"[A-Z]", "A", re.sub(r"[a-z]", "a", re.sub(r"\d", "0", v)))
    assert shape(made) == shape(value) and P.pseudonym(made, key, back=True) == value and made == P.pseudonym(value, key)


def test_feistel_is_a_permutation():
    for n, radix in ((1, 10), (2, 10), (3, 10), (4, 5)):
        values = [[(v // radix**k) % radix for k in range(n)] for v in range(radix**n)]
        assert len({tuple(P.feistel(v, radix, b"k")) for v in values}) == radix**n


def test_identity_checks():
    assert P._known_id("12345678Z") and not P._known_id("12345678A")
    assert P._known_id("529.982.247-25") and not P._known_id("529.982.247-26")
    assert P._known_id("11010519491231002X") and not P._known_id("110105194912310021")


def test_tables(spark):
    a, b = "call +44 1632 960822", "mail x.y@z.example\nDNI 29787068G"
    rows = [(1, a), (1, a), (2, b), (3, None), (4, ""), (None, a), (5, "word " * 20_000 + a), (6, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' as kind")
    assert {tuple(r) for r in P.find_personal(df).collect()} == {(1, 1, "phone"), (2, 1, "email"), (2, 2, "id_number"), (5, 1, "phone"), (6, 1, "email"), (6, 2, "id_number")}
    out = P.pseudonymize(df, "key").collect()
    texts = {r.doc_id: r.text for r in out}
    assert len(out) == 8 and texts[2] == texts[6] and "29787068G" not in texts[2] and re.match(r"call \[PHONE \+\d\d \d{4} \d{6}\]$", texts[1]) and texts[3] is None and texts[4] == ""
    assert P.pseudonymize(df, "other").where("doc_id = 1").first().text != texts[1]
    assert P.find_personal(df.limit(0)).count() == 0 and P.pseudonymize(df.limit(0), "k").count() == 0


def test_prefilters_pass_every_alternative():
    for a, b in ("[]", "()", "{}", "<>"):
        for at in ("at", "a", "AT", "At", "arroba", "arobase", "ät", "@"):
            for gap in ("", " "):
                line = f"write to jan.novak {a}{gap}{at}{gap}{b} example {a}{gap}dot{gap}{b} com"
                assert bool(P.SPELLED.search(line)) == ("email" in {m.kind for m in P.line_mentions(line)}), line
    for at in (" AT ", " -AT- ", " _AT_ ", "_at_", " _at_ ", " arroba ", " arobase "):
        line = f"write to jan.novak{at}example.com"
        assert bool(P.SPELLED.search(line)) == ("email" in {m.kind for m in P.line_mentions(line)}), line
    assert [m.kind for m in P.line_mentions("jan\tat\texample\tdot\tcom")] == ["email"]
    for box in ("P.O. Box", "PO Box", "p.o.box", "post office box", "Postfach", "boite postale", "B.P.", "b.p.", "Apartado", "apartado de correos", "Caixa Postal"):
        assert [m.kind for m in P.line_mentions(f"send it to {box} 1420")] == ["address"], box
    for label in ("home address", "Adresse", "Anschrift", "Direccion", "domicilio", "endereco", "ship_to"):
        assert "address" in {m.kind for m in P.line_mentions(f"{label}: 12 Kesten Mirova, Harbin")}, label
    assert "name" in {m.kind for m in P.line_mentions("it was Anna-Lena Schmidt again")}


def test_names_by_context():
    for line, name in (
        ("Margaret Okonkwo said the deploy was fine.", "Margaret Okonkwo"), ("Yesterday I met Siobhan Fitzgerald at the office.", "Siobhan Fitzgerald"), ("We spoke with Rajesh Krishnamurthy about it.", "Rajesh Krishnamurthy"),
        ("According to Hiroshi Tanaka, it works.", "Hiroshi Tanaka"), ("Then Agnieszka Kowalczyk wrote a patch.", "Agnieszka Kowalczyk"), ("Ich habe mit ihr gesprochen, und Ottilie Brennecke sagte nein.", "Ottilie Brennecke"),
    ):
        assert [line[m.start : m.end] for m in P.line_mentions(line) if m.kind == "name"] == [name], line
    for line in ("The Ocean Gateway said no", "The Release Team wrote it", "we met Service Level goals", "IBAN DE89 3704 0044 0532 0130 00"):
        assert not list(P.line_mentions(line)), line


def test_pseudonyms_stay_valid():
    rng = random.Random(6)
    for _ in range(150):
        n = rng.randrange(10**8)
        dni = f"{n:08d}{P.DNI_LETTERS[n % 23]}"
        cpf = P._refilled("000.000.000-00", P._cpf_checks(f"{rng.randrange(10**9):09d}"))
        body = f"{rng.randrange(100_000, 1_000_000)}{P._date(rng.randrange(P._DAYS)):%Y%m%d}{rng.randrange(1000):03d}"
        resident = body + "10X98765432"[sum(int(c) * w for c, w in zip(body, P.RESIDENT_WEIGHTS)) % 11]
        for value in (dni, cpf, resident):
            made = P.checked_pseudonym(value, b"key")
            assert P._known_id(made) and made != value and P.checked_pseudonym(made, b"key", back=True) == value
        made = P.checked_pseudonym("AB 12 34 56 C", bytes([rng.randrange(256)]))
        assert P.NINO.fullmatch(made)
        ssn = "219-09-9999"
        made = P.checked_pseudonym(ssn, bytes([rng.randrange(256)]) * 2)
        assert P.SSN.fullmatch(made) and P._issued(re.sub("-", "", made))
    assert len({P.permuted(n, 1000, b"k") for n in range(1000)}) == 1000


def test_spellings_of_a_phone_number_stay_linked():
    spelled = ["+1 415 555 0132", "(415) 555-0132", "001 415 555 0132", "415.555.0132"]
    assert len({re.sub(r"\D", "", P.phone_pseudonym(v, b"k"))[-10:] for v in spelled}) == 1 and P.phone_pseudonym(spelled[0], b"k").startswith("+1 ")
    for v in (*spelled, "+49 (0)30 1234567", "030 1234567", "+44 20 7946 0123 ext. 12", "555-0132"):
        made = P.phone_pseudonym(v, b"k")
        assert re.sub(r"\d", "0", made) == re.sub(r"\d", "0", v) and P.phone_pseudonym(made, b"k", back=True) == v
    assert P.phone_pseudonym("+49 (0)30 1234567", b"k")[-10:] == "".join(P.phone_pseudonym("030 1234567", b"k"))[-10:]


def test_birth_dates():
    for v in ("1984-02-29", "29.02.1984", "02/28/1984", "31/12/1999"):
        made = P.date_pseudonym(v, b"k")
        assert made != v and P.date_pseudonym(made, b"k", back=True) == v
    assert P.date_pseudonym("31.02.1984", b"k") is None
    text = "born on 1984-02-29, deployed on 2024-02-29"
    assert [text[m.start : m.end] for m in P.birth_dates(text)] == ["1984-02-29"]
