from quillspark import providers
from quillspark.operators import embedding as E
from quillspark.operators import retrieval as V


class Once(providers.SourceWriter):
    """Fails at the first call of all about a text, and always at bad ones."""

    def __init__(self):
        self.seen = set()

    def write(self, prompt, limit):
        if "bad" in prompt or prompt not in self.seen:
            self.seen.add(prompt)
            raise OSError("busy")
        return super().write(prompt, limit)


class Placing:
    def write(self, prompt, limit):
        if prompt.endswith("bad"):
            raise OSError("busy")
        return f"Of {prompt.count('part')} parts." if "part" in prompt.splitlines()[-1] else " "


def test_answers_with_failures_and_without_sources(spark, monkeypatch):
    rows = [("q", "[Source: a.pdf | Category: X]\ntext\n\n---\n\n[Source: b.pdf | Category: X]\n"), ("q", "  "), ("q", None), (None, "[Source: c.pdf | Category: X]"), ("bad", "[Source: c.pdf | Category: X]")]
    got = V.answered(spark.createDataFrame(rows, "question string, context string").repartition(2), Once).collect()
    assert sorted((r.question or "", r.answer or "", r.answer_status) for r in got) == sorted([("q", "See a.pdf, b.pdf.", "answered"), ("q", "", "no_sources"), ("q", "", "no_sources"), ("", "See c.pdf.", "answered"), ("bad", "", "failed")])
    assert V.answered(spark.createDataFrame([], "question string, context string"), Once).count() == 0


def test_chunks_with_their_place_in_the_document(spark):
    long = ["part one " * 60, "part two " * 60, "bad"]
    rows = [(1, "Contracts", [(t.strip(), "", "text") for t in long]), (2, "Miscellaneous", [("part", "", "text")]), (3, "Invoices", []), (4, "Invoices", [("other", "", "text")])]
    docs = spark.createDataFrame(rows, "document_id long, final_category string, chunks array<struct<text:string,heading_context:string,chunk_type:string>>")
    plain = {(r.document_id, r.chunk_index): r for r in E.embed_documents(docs, providers.HashEmbedder).collect()}
    told = {(r.document_id, r.chunk_index): r for r in E.embed_documents(docs, providers.HashEmbedder, writer=Placing).collect()}
    assert plain.keys() == told.keys() and {k: r.embedding_status for k, r in plain.items()} == {k: r.embedding_status for k, r in told.items()}
    placed = {k for k in told if told[k].chunk_text != plain[k].chunk_text}
    assert placed and all(told[k].chunk_text.startswith("Of ") and told[k].chunk_text.endswith("\n\n" + plain[k].chunk_text) and told[k].embedding != plain[k].embedding for k in placed)
    assert {k[0] for k in placed} == {1}
