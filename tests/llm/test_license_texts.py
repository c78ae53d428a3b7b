import re

import pytest

from tidepanel.llm import licenses


def found(text):
    words = licenses.words_of(text.encode())
    return {label for label, markups in licenses.TEMPLATES.items() for t in map(licenses.Template, markups) if any(t.accepts(words, i) for i in range(len(words)))}


def plain(label):
    return re.sub(r"<<var[^>]*>>", "the owner", re.sub(r"<<(begin|end)Optional>>", "", licenses.TEMPLATES[label][0]))


@pytest.mark.parametrize("label", ["MIT-text", "BSD-2-Clause-text", "BSD-3-Clause-text", "ISC-text"])
def test_whole_texts_alone(label):
    text = plain(label)
    assert found(text) == {label}
    words = text.split()
    assert found(" ".join(words[:-1])) == set() and found(" ".join(words[: len(words) // 2] + words[len(words) // 2 + 1 :])) == set()


def test_altered_conditions_are_rejected():
    mit = plain("MIT-text")
    condition = mit[mit.index("subject to") : mit.index("the software is provided")]
    assert found(mit.replace(condition, "")) == set()  # as in MIT-0
    assert found(mit.replace("the software is provided", "the software shall be used for good not evil the software is provided")) == set()
    four = plain("BSD-3-Clause-text").replace("neither the name", "all advertising materials must display an acknowledgement neither the name")
    assert found(four) == set()


def test_gnu_notice():
    notice = "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License"
    assert found(notice.format(3)) == {"GPL-3.0"} and found(notice.format(2)) == {"GPL-2.0"}
