"""Character references against the standard library."""
import html
import random
from html.entities import html5

from feedscope.functions import references as R


def test_references_equal_the_standard_library(spark):
    rng = random.Random(3)
    texts = ["", "&", "&&", "&#;", "&#x;", "&#0;", "&#13;", "&#129;", "&#x110000;", "&#99999999999999;", "&#xfffe;", "&notit;", "&notin;", "&ampamp;",
             "&amp;amp;", "&agrave;", "&Aacutex", "&frac34x;", "&lt", "&x;", "a&b;c", "&#65 &#x41x", "&thisisaverylongnamethatnobodyknowsatallreally;", "&\n"]
    texts += ["&" + n for n in html5] + ["x&" + n.rstrip(";") + "q;" for n in html5]
    texts += ["".join(rng.choice(["&", "amp", "lt;", "#", "x41", ";", "not", "a", " ", "é"]) for _ in range(12)) for _ in range(500)]
    texts += [f"&#{c};&#x{c:x}" for c in [*range(300), *(rng.randrange(0x120000) for _ in range(200))]]
    df = spark.createDataFrame([(t, html.unescape(t)) for t in texts], "t string, w string")
    assert df.where(~R.unescape("t").eqNullSafe(df["w"])).collect() == []
    assert spark.createDataFrame([(None,)], "t string").select(R.unescape("t")).first()[0] == ""
