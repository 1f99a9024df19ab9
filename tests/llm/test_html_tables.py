"""Text and elements misplaced in tables: all of it stays, before the table, as browsers show it."""

import pytest

from larkspur.llm import html


@pytest.mark.parametrize(
    "page,text",
    [
        ("<table><form><tr><td>x</td></tr></form></table>", "x"), ("<table><tr><form><td>x</td></form></tr></table>", "x"), ("<table><tbody><form><tr><td>x<td>y</form></table>z", "x  y\n\nz"),
        ("<table>a<tr><td>x</table>b", "a\n\nx\n\nb"), ("<table><tr>a<td>x</table>", "a\n\nx"), ("<table><tbody>a<tr><td>x</table>", "a\n\nx"),
        ("<table><div>a</div><tr><td>x</table>", "a\n\nx"), ("<table><div>a<tr><td>x<td>y</table>", "a\n\nx  y"), ("<table><tr><p>a<td>x</table>", "a\n\nx"), ("<table><tr><td>x<tr><a href=y>b</a><td>z</table>", "b\n\nx\nz"),
        ("<table><center><span>a</span></center><tbody><tr><td>x</table>", "a\n\nx"), ("<table hidden>a<tr><td>x</table>b", "ab"), ("<table><script>s</script><tr><td>x</table>", "x"),
        ("<table><caption>c<tr><td>x</table>", "c\nx"), ("<table><colgroup><col>a<tr><td>x</table>", "a\n\nx"), ("<table><tr><td>x<tr><table><tr><td>y</table>", "x\n\ny"),
        ("<table><tr><td><table>a<tr><td>x</table><td>y</table>", "a  y\n\nx"), ("<table> <tr> <td>x</td> </tr> </table>", "x"), ("<form><table><tr><td>x</td></tr></table>b</form>c", "x\n\nb\nc"),
        ("<table><tr><td><form>a</form><td>b</table>", "a  b"), ("<table>a<br>b<tr><td>x</table>", "a\nb\n\nx"),
    ],
)
def test_misplaced(page, text):
    assert html.render(page) == text
