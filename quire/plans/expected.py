"""Expected results of the mathematics parsers for the zones of ``plans.documents``, checked by hand.

Rows are SQL VALUES, one zone after the other; the first column is the zone's number, <a> and <b>
stand for the row's own numbers.
"""

#: (k, ok, canonical, error, offset, token)
CANONICAL = r"""
(0, True, '\sum_{i=a}^{n}a_{i}=x^{<b>}', NULL, NULL, NULL),
(1, True, '\frac{a}{b}+\sqrt{x}', NULL, NULL, NULL),
(2, True, '\int_{0}^{<a>}f\left(x\right)\,dx+<b>', NULL, NULL, NULL),
(3, True, '\begin{pmatrix}
<a> & <b> \\
c & d
\end{pmatrix}', NULL, NULL, NULL),
(4, True, '\ln\tan x_{a}\leq <b>', NULL, NULL, NULL),
(5, True, '\mathbf{AB}\cdot\vec{v}_{<b>}', NULL, NULL, NULL),
(6, False, NULL, 'malformed', 3, '^'),
(7, False, NULL, 'unknown_macro', 0, '\nosuch'),
(8, True, '(a+<b>', NULL, NULL, NULL),
(9, True, 'x_{<a>}\in\mathbb{R}', NULL, NULL, NULL)
"""

#: (k, pos, kind, token)
TOKENS = r"""
(0, 0, 'macro', '\sum'),
(0, 4, 'sub', '_'),
(0, 5, 'lbrace', '{'),
(0, 6, 'char', 'i'),
(0, 7, 'char', '='),
(0, 8, 'lbrace', '{'),
(0, 9, 'char', 'a'),
(0, 10, 'rbrace', '}'),
(0, 11, 'rbrace', '}'),
(0, 12, 'sup', '^'),
(0, 13, 'char', 'n'),
(0, 15, 'char', 'a'),
(0, 16, 'sub', '_'),
(0, 17, 'char', 'i'),
(0, 19, 'char', '='),
(0, 21, 'char', 'x'),
(0, 22, 'sup', '^'),
(0, 23, 'digits', '<b>'),
(0, 24, 'eof', ''),
(1, 0, 'macro', '\frac'),
(1, 5, 'lbrace', '{'),
(1, 6, 'lbrace', '{'),
(1, 7, 'char', 'a'),
(1, 8, 'rbrace', '}'),
(1, 9, 'rbrace', '}'),
(1, 10, 'lbrace', '{'),
(1, 11, 'lbrace', '{'),
(1, 12, 'char', 'b'),
(1, 13, 'rbrace', '}'),
(1, 14, 'rbrace', '}'),
(1, 16, 'char', '+'),
(1, 18, 'macro', '\sqrt'),
(1, 23, 'lbrace', '{'),
(1, 24, 'char', 'x'),
(1, 25, 'rbrace', '}'),
(1, 26, 'eof', ''),
(2, 0, 'macro', '\int'),
(2, 4, 'sub', '_'),
(2, 5, 'digits', '0'),
(2, 6, 'sup', '^'),
(2, 7, 'digits', '<a>'),
(2, 9, 'char', 'f'),
(2, 10, 'char', '('),
(2, 11, 'char', 'x'),
(2, 12, 'char', ')'),
(2, 13, 'macro', '\,'),
(2, 15, 'char', 'd'),
(2, 16, 'char', 'x'),
(2, 18, 'char', '+'),
(2, 20, 'digits', '<b>'),
(2, 21, 'eof', ''),
(3, 0, 'macro', '\left'),
(3, 5, 'char', '('),
(3, 7, 'begin', 'matrix'),
(3, 22, 'digits', '<a>'),
(3, 24, 'amp', '&'),
(3, 26, 'digits', '<b>'),
(3, 28, 'rowsep', '\\'),
(3, 31, 'char', 'c'),
(3, 33, 'amp', '&'),
(3, 35, 'char', 'd'),
(3, 37, 'end', 'matrix'),
(3, 50, 'macro', '\right'),
(3, 56, 'char', ')'),
(3, 57, 'eof', ''),
(4, 0, 'macro', '\ln'),
(4, 4, 'macro', '\tan'),
(4, 9, 'char', 'x'),
(4, 10, 'sub', '_'),
(4, 11, 'lbrace', '{'),
(4, 12, 'lbrace', '{'),
(4, 13, 'char', 'a'),
(4, 14, 'rbrace', '}'),
(4, 15, 'rbrace', '}'),
(4, 17, 'macro', '\le'),
(4, 21, 'digits', '<b>'),
(4, 22, 'eof', ''),
(5, 0, 'macro', '\mathbf'),
(5, 7, 'lbrace', '{'),
(5, 8, 'char', 'A'),
(5, 9, 'char', 'B'),
(5, 10, 'rbrace', '}'),
(5, 12, 'macro', '\cdot'),
(5, 18, 'macro', '\vec'),
(5, 22, 'lbrace', '{'),
(5, 23, 'char', 'v'),
(5, 24, 'rbrace', '}'),
(5, 25, 'sub', '_'),
(5, 26, 'digits', '<b>'),
(5, 27, 'eof', ''),
(6, 0, 'char', 'x'),
(6, 1, 'sup', '^'),
(6, 2, 'digits', '<a>'),
(6, 3, 'sup', '^'),
(6, 4, 'digits', '<b>'),
(6, 5, 'eof', ''),
(7, 0, 'macro', '\nosuch'),
(7, 7, 'lbrace', '{'),
(7, 8, 'lbrace', '{'),
(7, 9, 'char', 'a'),
(7, 10, 'rbrace', '}'),
(7, 11, 'rbrace', '}'),
(7, 13, 'char', '+'),
(7, 15, 'digits', '<b>'),
(7, 16, 'eof', ''),
(8, 0, 'char', '('),
(8, 2, 'char', 'a'),
(8, 4, 'char', '+'),
(8, 6, 'digits', '<b>'),
(8, 7, 'eof', ''),
(9, 0, 'defspec', '\newcommand{\R}{\mathbb{R}}'),
(9, 28, 'char', 'x'),
(9, 29, 'sub', '_'),
(9, 30, 'digits', '<a>'),
(9, 32, 'macro', '\in'),
(9, 36, 'macro', '\R'),
(9, 38, 'eof', '')
"""

#: (k, node_id, parent_id, slot, ord, type, value, props, end_id, span)
NODES = r"""
(0, 0, NULL, '', 0, 'row', '', '{}', 16, '∑i=anai=x<b>'),
(0, 1, 0, 'item', 0, 'nary', '∑', '{}', 12, '∑i=anai'),
(0, 2, 1, 'sub', 0, 'row', '', '{}', 7, 'i=a'),
(0, 3, 2, 'item', 0, 'ident', 'i', '{}', 4, 'i'),
(0, 4, 2, 'item', 1, 'op', '=', '{}', 5, '='),
(0, 5, 2, 'item', 2, 'row', '', '{}', 7, 'a'),
(0, 6, 5, 'item', 0, 'ident', 'a', '{}', 7, 'a'),
(0, 7, 1, 'sup', 1, 'ident', 'n', '{}', 8, 'n'),
(0, 8, 1, 'e', 2, 'row', '', '{}', 12, 'ai'),
(0, 9, 8, 'item', 0, 'script', '', '{}', 12, 'ai'),
(0, 10, 9, 'e', 0, 'ident', 'a', '{}', 11, 'a'),
(0, 11, 9, 'sub', 1, 'ident', 'i', '{}', 12, 'i'),
(0, 12, 0, 'item', 1, 'op', '=', '{}', 13, '='),
(0, 13, 0, 'item', 2, 'script', '', '{}', 16, 'x<b>'),
(0, 14, 13, 'e', 0, 'ident', 'x', '{}', 15, 'x'),
(0, 15, 13, 'sup', 1, 'num', '<b>', '{}', 16, '<b>'),
(1, 0, NULL, '', 0, 'row', '', '{}', 12, 'ab+x'),
(1, 1, 0, 'item', 0, 'frac', '', '{"type":"bar"}', 8, 'ab'),
(1, 2, 1, 'num', 0, 'row', '', '{}', 5, 'a'),
(1, 3, 2, 'item', 0, 'row', '', '{}', 5, 'a'),
(1, 4, 3, 'item', 0, 'ident', 'a', '{}', 5, 'a'),
(1, 5, 1, 'den', 1, 'row', '', '{}', 8, 'b'),
(1, 6, 5, 'item', 0, 'row', '', '{}', 8, 'b'),
(1, 7, 6, 'item', 0, 'ident', 'b', '{}', 8, 'b'),
(1, 8, 0, 'item', 1, 'op', '+', '{}', 9, '+'),
(1, 9, 0, 'item', 2, 'rad', '', '{}', 12, 'x'),
(1, 10, 9, 'e', 0, 'row', '', '{}', 12, 'x'),
(1, 11, 10, 'item', 0, 'ident', 'x', '{}', 12, 'x'),
(2, 0, NULL, '', 0, 'row', '', '{}', 14, '∫0<a>fxdx+<b>'),
(2, 1, 0, 'item', 0, 'nary', '∫', '{}', 12, '∫0<a>fxdx'),
(2, 2, 1, 'sub', 0, 'num', '0', '{}', 3, '0'),
(2, 3, 1, 'sup', 1, 'num', '<a>', '{}', 4, '<a>'),
(2, 4, 1, 'e', 2, 'row', '', '{}', 12, 'fxdx'),
(2, 5, 4, 'item', 0, 'ident', 'f', '{}', 6, 'f'),
(2, 6, 4, 'item', 1, 'delim', '', '{"begChr":"(","endChr":")"}', 9, 'x'),
(2, 7, 6, 'e', 0, 'row', '', '{}', 9, 'x'),
(2, 8, 7, 'item', 0, 'ident', 'x', '{}', 9, 'x'),
(2, 9, 4, 'item', 2, 'space', ' ', '{}', 10, ''),
(2, 10, 4, 'item', 3, 'ident', 'd', '{}', 11, 'd'),
(2, 11, 4, 'item', 4, 'ident', 'x', '{}', 12, 'x'),
(2, 12, 0, 'item', 1, 'op', '+', '{}', 13, '+'),
(2, 13, 0, 'item', 2, 'num', '<b>', '{}', 14, '<b>'),
(3, 0, NULL, '', 0, 'row', '', '{}', 12, 'pmatrix<a><b>cd'),
(3, 1, 0, 'item', 0, 'matrix', 'pmatrix', '{}', 12, 'pmatrix<a><b>cd'),
(3, 2, 1, 'mr', 0, 'matrix_row', '', '{}', 7, '<a><b>'),
(3, 3, 2, 'e', 0, 'row', '', '{}', 5, '<a>'),
(3, 4, 3, 'item', 0, 'num', '<a>', '{}', 5, '<a>'),
(3, 5, 2, 'e', 1, 'row', '', '{}', 7, '<b>'),
(3, 6, 5, 'item', 0, 'num', '<b>', '{}', 7, '<b>'),
(3, 7, 1, 'mr', 1, 'matrix_row', '', '{}', 12, 'cd'),
(3, 8, 7, 'e', 0, 'row', '', '{}', 10, 'c'),
(3, 9, 8, 'item', 0, 'ident', 'c', '{}', 10, 'c'),
(3, 10, 7, 'e', 1, 'row', '', '{}', 12, 'd'),
(3, 11, 10, 'item', 0, 'ident', 'd', '{}', 12, 'd'),
(4, 0, NULL, '', 0, 'row', '', '{}', 12, 'lntanxa≤<b>'),
(4, 1, 0, 'item', 0, 'func', '', '{}', 10, 'lntanxa'),
(4, 2, 1, 'fName', 0, 'opname', 'ln', '{}', 3, 'ln'),
(4, 3, 1, 'e', 1, 'func', '', '{}', 10, 'tanxa'),
(4, 4, 3, 'fName', 0, 'opname', 'tan', '{}', 5, 'tan'),
(4, 5, 3, 'e', 1, 'script', '', '{}', 10, 'xa'),
(4, 6, 5, 'e', 0, 'ident', 'x', '{}', 7, 'x'),
(4, 7, 5, 'sub', 1, 'row', '', '{}', 10, 'a'),
(4, 8, 7, 'item', 0, 'row', '', '{}', 10, 'a'),
(4, 9, 8, 'item', 0, 'ident', 'a', '{}', 10, 'a'),
(4, 10, 0, 'item', 1, 'op', '≤', '{}', 11, '≤'),
(4, 11, 0, 'item', 2, 'num', '<b>', '{}', 12, '<b>'),
(5, 0, NULL, '', 0, 'row', '', '{}', 10, '𝐀𝐁·⃗v<b>'),
(5, 1, 0, 'item', 0, 'row', '', '{}', 4, '𝐀𝐁'),
(5, 2, 1, 'item', 0, 'ident', '𝐀', '{}', 3, '𝐀'),
(5, 3, 1, 'item', 1, 'ident', '𝐁', '{}', 4, '𝐁'),
(5, 4, 0, 'item', 1, 'op', '·', '{}', 5, '·'),
(5, 5, 0, 'item', 2, 'script', '', '{}', 10, '⃗v<b>'),
(5, 6, 5, 'e', 0, 'accent', '⃗', '{}', 9, '⃗v'),
(5, 7, 6, 'e', 0, 'row', '', '{}', 9, 'v'),
(5, 8, 7, 'item', 0, 'ident', 'v', '{}', 9, 'v'),
(5, 9, 5, 'sub', 1, 'num', '<b>', '{}', 10, '<b>'),
(8, 0, NULL, '', 0, 'row', '', '{}', 5, '(a+<b>'),
(8, 1, 0, 'item', 0, 'op', '(', '{}', 2, '('),
(8, 2, 0, 'item', 1, 'ident', 'a', '{}', 3, 'a'),
(8, 3, 0, 'item', 2, 'op', '+', '{}', 4, '+'),
(8, 4, 0, 'item', 3, 'num', '<b>', '{}', 5, '<b>'),
(9, 0, NULL, '', 0, 'row', '', '{}', 7, 'x<a>∈ℝ'),
(9, 1, 0, 'item', 0, 'script', '', '{}', 4, 'x<a>'),
(9, 2, 1, 'e', 0, 'ident', 'x', '{}', 3, 'x'),
(9, 3, 1, 'sub', 1, 'num', '<a>', '{}', 4, '<a>'),
(9, 4, 0, 'item', 1, 'op', '∈', '{}', 5, '∈'),
(9, 5, 0, 'item', 2, 'row', '', '{}', 7, 'ℝ'),
(9, 6, 5, 'item', 0, 'ident', 'ℝ', '{}', 7, 'ℝ')
"""
