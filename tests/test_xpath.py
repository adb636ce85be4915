import pytest

from sylva.model import PathSyntaxError, UnsupportedPathError
from sylva.plans.match import pattern
from sylva.plans.xpath import parse, read_queries


@pytest.mark.parametrize("path", ["/", "/a", "a", "//a", "/a//b/@c", "/a/*/@*", "//a/text()", "/a/./b", "/s/p[2]/q[1]", "//p[@k]/q", "//p[@k=7]/q", "//p[contains(q/text(),'seven')]/q", "//p[contains(@t,'X')]/@k", "//b[starts-with(@t,'X')]/c", "/a/b[2][@y>=1.5]/c", "//b[text()!='x']/c", "ns:a/b-c"])
def test_supported(path):
    assert parse(path).text == path


@pytest.mark.parametrize("path", ["/a/../b", "/a/(b|c)", "/a|/b", "//a[2]", "//a[@x]", "/a[@x][2]/b", "//a[@x and @y]/b", "//a[@x or @y]/b", "//a[b=1]/c", "//a[.='x']/b", "//a[contains(.,'x')]/b", "/a[1][2]/b", "//a[last()]/b"])
def test_refused_in_strict_mode(path):
    with pytest.raises(UnsupportedPathError):
        parse(path)


@pytest.mark.parametrize("path", ["/a/../b", "/a/(b|c)", "/a|/b", "//a[2]", "//a[@x]", "//a[@x and @y]/b", "//a[b=1]/c", "//a[.='x']/b"])
def test_superset(path):
    assert parse(path, strict=False).text == path


@pytest.mark.parametrize("path", ["", "  ", "/a/", "//", "/a[", "/a[]/b", "/a[0]/b", "/a[1=@x]/b", "/a/@b/c", "/a/text()/b", "/a b", "/a[@x=]/b", "/a[contains(@x,3)]/b", "/@", "/a)"])
def test_malformed(path):
    with pytest.raises((PathSyntaxError, UnsupportedPathError)):
        parse(path, strict=False)


def test_one_position_only():
    with pytest.raises(UnsupportedPathError):
        parse("/a[1][2]/b", strict=False)


def test_patterns_and_query_files():
    import re

    p = pattern(parse("/a//b/*/@x").steps)
    assert re.fullmatch(p, "/a/b/c/@x") and re.fullmatch(p, "/a/q/r/b/c/@x") and not re.fullmatch(p, "/a/b/@x")
    assert [q.text for q in read_queries("/a\n\n//b/@c\n")] == ["/a", "//b/@c"]
