import pytest

from quillgrid.operators.workspace import Workspace
from quillgrid.session import InvalidInput, Unsupported
from quillgrid.sources import packages


@pytest.fixture
def session(spark):
    return Workspace(spark)


def test_registry_and_listeners(session):
    heard = []
    note = session.new("text", "Note")
    session.listen(note, lambda command, result: heard.append((command, result)))
    assert session.execute(note, ".uno:AppendHeading", level=9, text="T") is True
    session.execute(note, ".uno:InsertText", text="some words")
    session.execute(note, ".uno:AppendTable", rows="a | b\nc|d")
    assert session.execute(note, ".uno:GetSelectionText") == "T\n\nsome words\n\na\tb\n\nc\td"
    assert session.save(note, "md").decode().startswith("###### T\n\nsome words")
    assert session.execute(note, ".uno:Bold") and session.get(note).content[1][3] == "**some words**"
    assert session.execute(note, ".uno:Uppercase").startswith("**T**".upper())
    assert heard[0] == (".uno:AppendHeading", True) and len(heard) == 6
    with pytest.raises(Unsupported):
        session.execute(note, ".uno:SetCell")
    with pytest.raises(Unsupported):
        session.execute(note, "InsertText")
    session.close(note)
    with pytest.raises(InvalidInput):
        session.get(note)
    with pytest.raises(InvalidInput):
        session.new("poem", "x")


def test_commands_of_every_kind(session):
    book = session.load("spreadsheet", "Book", b"Item,Qty\nPen,2\n")
    session.execute(book, ".uno:AppendRow", row="Ink, 3,,x")
    session.execute(book, ".uno:SetCell", row=5, col=1, value="=B2*B3")
    assert session.execute(book, ".uno:EvaluateCell", row=5, col=1) == 6.0 and session.execute(book, ".uno:EvaluateCell", row=2, col=3) == "x"
    session.execute(book, ".uno:SetCell", row=5, col=1, value=" ")
    with pytest.raises(InvalidInput):
        session.execute(book, ".uno:EvaluateCell", row=5, col=1)
    assert session.save(book, "csv") == b"Item,Qty,,\nPen,2,,\nInk,3,,x"
    deck = session.new("presentation", "Deck")
    assert session.execute(deck, ".uno:InsertSlide", title="One") == 1 and session.execute(deck, ".uno:InsertSlide") == 2
    session.execute(deck, ".uno:InsertBullets", slide=2, items="a| |b")
    session.execute(deck, ".uno:InsertTextBox", slide=1, text="box")
    session.execute(deck, ".uno:InsertShape", slide=1, kind="ellipse")
    assert [x for x in packages.pptx_elements(session.save(deck, "pptx")) if x[2]] == [(1, "text_box", "One"), (1, "text_box", "box"), (2, "text_box", "Slide"), (2, "text_box", "• a\n• b")]
    page = session.new("drawing", "Page")
    assert session.execute(page, ".uno:InsertPage") == 1
    session.execute(page, ".uno:InsertShape", kind="line", x=1, y=2, width=13, height=4, text="hi")
    assert list(packages.odg_elements(session.save(page, "odg")))[1:] == [(1, "line", 1.0, 2.0, 13.0, 4.0, ""), (1, "text_box", 3.0, 4.0, 9.0, 10.0, "hi")]
    formula = session.load("formula", "F", b"x")
    session.execute(formula, ".uno:SetFormula", formula=r"\frac{a}{2}")
    assert session.execute(formula, ".uno:ToMathML") == "<mfrac><mi>a</mi><mn>2</mn></mfrac>" and session.save(formula, "txt") == b"(a)/(2)"
    data = session.load("database", "D", b"name,age\nAlice,30\nBob,22\n")
    assert session.execute(data, ".uno:CreateTable", name="t", columns="k, v") == "t" and session.execute(data, ".uno:InsertRow", table="t", row="1,")
    with pytest.raises(InvalidInput):
        session.execute(data, ".uno:InsertRow", table="none", row="1")
    assert session.execute(data, ".uno:ExecuteQuery", sql="SELECT name FROM data WHERE age >= 22 ORDER BY age DESC") == 2


def test_macros(session):
    a, b = session.new("text", "A"), session.new("text", "B")
    assert session.stop() == []
    session.record("m")
    session.execute(a, ".uno:InsertText", text="x")
    session.execute(a, ".uno:Uppercase")
    assert [c for c, _ in session.stop()] == [".uno:InsertText", ".uno:Uppercase"]
    session.execute(a, ".uno:InsertText", text="later")
    assert session.replay("m", b) == [True, "X"] and session.get(b).content == [("paragraph", None, None, "X")]
    with pytest.raises(InvalidInput):
        session.replay("none", b)


def test_autosave_and_recovery(session, spark, tmp_path):
    note = session.load("text", "A\tNote", b"hello\n\nworld", path="/x/y.txt")
    session.execute(session.new("spreadsheet", "Book"), ".uno:SetCell", value="7")
    folder = str(tmp_path / "saved")
    files = session.autosave(folder, now=5.0)
    assert len(files) == 2 and files[0].endswith("1-a-note.odt")
    manifest = (tmp_path / "saved" / "recovery.tsv").read_text()
    assert manifest.split("\n")[0].split("\t")[:3] == ["writer", "A Note", "odt"] and manifest.split("\n")[0].endswith("/x/y.txt\t5")
    (tmp_path / "saved" / "recovery.tsv").write_text(manifest + "bad line\nwriter\tgone\todt\t/none\t\t1\nposter\tx\todt\t" + files[0] + "\t\t1\n")
    other = Workspace(spark)
    opened = other.recover(folder)
    assert [(other.get(h).kind, other.get(h).title) for h in opened] == [("text", "A Note (Recovered)"), ("spreadsheet", "Book (Recovered)")]
    assert [x[3] for x in other.get(opened[0]).content] == ["hello", "world"] and other.get(opened[1]).content[0, 0][2] == 7.0
    assert other.recover(str(tmp_path)) == [] and session.get(note).title == "A\tNote"


def test_event_ring(session):
    for _ in range(520):
        session.services.publish("s", "t")
    log = session.services.event_log()
    assert log.count() == 500 and log.agg({"event_id": "max"}).first()[0] == 520 and session.report().count() == 10
