from pulse.operators.search_text import explode_search_results, explode_url_contents

LONG = "Body line with enough words to pass the gate. " * 6   # > 200 chars

RESP = f"""Intro text
WEB RESULTS:

Title: First
URL: https://one.example/a
Published: 2024-05-01
Description: only description text that is long enough to be kept as the body of the record ok
NEWS RESULTS:
Title: Second
URL: https://two.example/b
Description: ignored because snippets follow later
Snippets:
- snippet one that is fairly long to help reach the minimum body size of eighty chars
- snippet two
Content：
{LONG}
Title: not a field inside content
URL: https://not.a.field/
web results:
URL: https://three.example/c
Description: short
"""


def test_search_blocks(spark):
    df = spark.createDataFrame([("topic", "news", "q", RESP), ("t", "news", "q", "Error: failed")],
                               "topic string, source_type string, query string, text string")
    rows = {r.url: r for r in explode_search_results(df).collect()}
    assert set(rows) == {"https://one.example/a", "https://two.example/b"}   # third: body < 80
    a = rows["https://one.example/a"]
    assert a.content.startswith("only description") and a.published_date == "2024-05-01"
    assert a.result_section == "web" and a.livecrawled is False
    b = rows["https://two.example/b"]
    assert b.title == "Second" and b.result_section == "news"
    assert "Title: not a field inside content" in b.content      # content is not parsed
    assert b.content.startswith("Body line") and b.livecrawled is False


def test_snippets_when_content_short(spark):
    text = ("WEB RESULTS:\nURL: https://s.example/x\nTitle: A\nTitle: B\nSnippets:\n- " + "s" * 85 +
            "\n\n- not a snippet after blank\n- still not\nContent:\nshort\n")
    df = spark.createDataFrame([("t", "news", "q", text)], "topic string, source_type string, query string, text string")
    r = explode_search_results(df).first()
    assert r.title == "B"                       # last one wins
    assert r.content == "s" * 85          # blank line closed the snippets; short content ignored


def test_url_contents(spark):
    text = ("URL: https://c.example/1\nPage title line\nContent:\n" + "c" * 90 +
            "\nTitle: Late Title\nmore\nURL: https://c.example/2\nContent:\n" + "d" * 79 + "\n")
    df = spark.createDataFrame([(text,)], "text string")
    rows = explode_url_contents(df).collect()
    assert [r.url for r in rows] == ["https://c.example/1"]
    assert rows[0].title == "Late Title" and rows[0].content == "c" * 90 + "\nmore"


def test_unicode_white_space_loses_no_record(spark):
    body = "long enough description " * 5
    text = ("WEB RESULTS:\u00a0\n\u00a0URL: https://n.example/1\nTitle: A\u2028B\nDescription: one\u0085two " + body +
            "\nNEWS RESULTS:\nURL:\u3000https://n.example/2\nDescription: " + body + "\n")
    df = spark.createDataFrame([("t", "news", "q", text)], "topic string, source_type string, query string, text string")
    rows = {r.url: r for r in explode_search_results(df).collect()}
    assert set(rows) == {"https://n.example/1", "https://n.example/2"}
    one = rows["https://n.example/1"]
    assert one.title == "A\u2028B" and one.content.startswith("one\u0085two")
