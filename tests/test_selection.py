import pytest

from tidemark.plans import selection as S


def test_left_associative():
    assert S.to_sql(S.parse("a = 1 OR b = 2 AND c = 3")) == "((a = 1 OR b = 2) AND c = 3)"


def test_order_limit():
    assert S.to_sql(S.parse("a > 1 ORDER BY b DESC, c LIMIT 5")) == "a > 1 ORDER BY b DESC, c ASC LIMIT 5"


def test_empty_is_true():
    assert S.parse("").where == S.Const(True)


@pytest.mark.parametrize("text", ["a =", "a", "a = 1 b", "a = 1 LIMIT x", "(a = 1", "a NOT = 1"])
def test_errors(text):
    with pytest.raises(S.SelectionError):
        S.parse(text)


def test_bind_counts():
    for values in ([], [1, 2]):
        with pytest.raises(S.SelectionError):
            S.bind(S.parse("a = ?"), values)


@pytest.mark.parametrize(("text", "empty"), [("a > 5 AND a < 3", True), ("a = 1 AND a = 2", True), ("a >= 3 AND a <= 3", False), ("a > 3 AND a <= 3", True), ("a > 5 OR a < 3", False)])
def test_contradiction(text, empty):
    assert S.contradicts(S.parse(text).where) is empty


@pytest.mark.parametrize("text", ["a = 'it''s'", 'p."a b"."x.y" >= -5', "a IN ('x', '') AND NOT (b IS NULL)", '"order" = TRUE'])
def test_text_form_parses_again(text):
    tree = S.parse(text)
    assert S.parse(S.to_sql(tree)) == tree


def test_strict_precedence():
    assert S.to_sql(S.parse("a = 1 OR b = 2 AND c = 3 OR d = 4", strict=True)) == "((a = 1 OR (b = 2 AND c = 3)) OR d = 4)"


@pytest.mark.parametrize(("text", "fault"), [("a =", S.MissingOperand), ("a = 1 AND", S.MissingOperand), ("a", S.InvalidPredicate), ("a = NULL", S.SyntaxFault), ("a = 1 LIMIT 1.5", S.SyntaxFault), ("a ; 1", S.SyntaxFault)])
def test_kinds_of_errors(text, fault):
    with pytest.raises(fault):
        S.parse(text)


def test_what_can_be_bound():
    for value in (None, {}, object(), b"x", [None]):
        with pytest.raises(S.BindingFault):
            S.bind(S.parse("a IN ?"), [value])
    with pytest.raises(S.BindingFault):
        S.bind(S.parse("a = ?"), [[1, 2]])
    with pytest.raises(S.SelectionError):
        S.EntityId("short")


def test_assume_null_folds():
    tree = S.parse("NOT (gone = 1) AND (a = 1 OR gone > 2) AND gone IS NULL").where
    assert S.assume_null(tree, lambda p: p.steps[0] == "gone") == S.parse("a = 1").where
