"""The five built-in styles, each stated by what differs from the defaults."""

from __future__ import annotations

import json

# Leaves of each style that differ from the defaults in ``styles.LEAVES``.
STYLES = {
    "apa7": {
        "style_id": "apa7",
        "title_page.title.position": "3-4 lines below top margin",
        "title_page.author_name.position": "one double-spaced line below title",
        "headings.level_4.indent_inches": 0.5,
        "headings.level_4.description": "Indented 0.5in, Bold, Title Case, Period. Text on same line.",
        "headings.level_5.indent_inches": 0.5,
        "headings.level_5.description": "Indented 0.5in, Bold Italic, Title Case, Period. Text on same line.",
    },
    "vancouver": {
        "style_name": "Vancouver (ICMJE)",
        "style_id": "vancouver",
        "csl_style": "vancouver",
        "default_typography.paragraph_alignment": "justify",
        "default_typography.first_line_indent_inches": 0.0,
        "title_page.title.font_size_pt": 14.0,
        "title_page.title.position": "upper third of page",
        "title_page.author_name.position": "below title",
        "abstract.label_alignment": "left",
        "abstract.keywords_italic": False,
        "abstract.keywords_indent": False,
        "headings.level_1.alignment": "left",
        "headings.level_1.font_size_pt": 14.0,
        "headings.level_1.case": "upper",
        "headings.level_1.description": "Flush Left, Bold, Uppercase",
        "headings.level_3.bold": False,
        "headings.level_3.case": "sentence_case",
        "headings.level_3.description": "Flush Left, Italic, Sentence Case",
        "headings.level_4.alignment": "left",
        "headings.level_4.bold": False,
        "headings.level_4.italic": True,
        "headings.level_4.case": "sentence_case",
        "headings.level_4.description": "Indented, Italic, Sentence Case, Period.",
        "headings.level_4.indent_inches": 0.5,
        "headings.level_5.indent_inches": 0.5,
        "headings.level_5.alignment": "left",
        "headings.level_5.bold": False,
        "headings.level_5.italic": False,
        "headings.level_5.case": "sentence_case",
        "headings.level_5.description": "Indented, Roman, Sentence Case, Period.",
        "running_head.content": "",
        "running_head.all_caps": False,
        "references.label_alignment": "left",
        "references.entry_indent_type": "none",
        "references.hanging_indent_inches": 0.0,
        "references.order": "order_of_appearance",
        "references.csl_style_name": "vancouver",
        "tables.title_italic": False,
        "tables.note_italic_prefix": False,
        "figures.number_italic": False,
        "figures.title_italic": False,
        "figures.note_italic_prefix": False,
        "in_text_citations.style": "numeric",
        "in_text_citations.parenthetical_format": "(1)",
        "in_text_citations.narrative_format": "1",
        "in_text_citations.et_al_threshold": 7,
        "in_text_citations.ampersand_in_parenthetical": False,
        "in_text_citations.and_in_narrative": False,
    },
    "ieee": {
        "style_name": "IEEE",
        "style_id": "ieee",
        "csl_style": "ieee",
        "page_layout.margin_top_inches": 0.75,
        "page_layout.margin_left_inches": 0.625,
        "page_layout.margin_right_inches": 0.625,
        "page_layout.columns": 2,
        "default_typography.font_size_pt": 10.0,
        "default_typography.line_spacing": 1.0,
        "default_typography.line_spacing_type": "single",
        "default_typography.paragraph_alignment": "justify",
        "default_typography.first_line_indent_inches": 0.25,
        "title_page.required": False,
        "title_page.title.font_size_pt": 24.0,
        "title_page.title.bold": False,
        "title_page.title.position": "top of first page",
        "title_page.author_name.font_size_pt": 11.0,
        "title_page.author_name.position": "below title",
        "title_page.affiliation.font_size_pt": 10.0,
        "title_page.affiliation.italic": True,
        "abstract.max_words": 200,
        "abstract.keywords_label": "Index Terms—",
        "abstract.keywords_indent": False,
        "headings.numbering_style": "ieee",
        "headings.level_1.bold": False,
        "headings.level_1.font_size_pt": 10.0,
        "headings.level_1.case": "upper",
        "headings.level_1.description": "Centered, Small Caps, Roman Numeral Prefix, e.g. I. INTRODUCTION",
        "headings.level_2.bold": False,
        "headings.level_2.italic": True,
        "headings.level_2.font_size_pt": 10.0,
        "headings.level_2.description": "Flush Left, Italic, Letter Prefix, e.g. A. Subsection Title",
        "headings.level_3.bold": False,
        "headings.level_3.italic": False,
        "headings.level_3.font_size_pt": 10.0,
        "headings.level_3.case": "sentence_case",
        "headings.level_3.standalone_line": False,
        "headings.level_3.ends_with_period": True,
        "headings.level_3.indent_inches": 0.25,
        "headings.level_3.description": "Indented, Italic, Numbered, Period. Text follows.",
        "headings.level_4.alignment": "left",
        "headings.level_4.bold": False,
        "headings.level_4.font_size_pt": 10.0,
        "headings.level_4.case": "sentence_case",
        "headings.level_4.indent_inches": 0.25,
        "headings.level_4.description": "Indented, Italic, Lowercase Letter, Period.",
        "headings.level_5.alignment": "left",
        "headings.level_5.bold": False,
        "headings.level_5.italic": False,
        "headings.level_5.font_size_pt": 10.0,
        "headings.level_5.case": "sentence_case",
        "headings.level_5.indent_inches": 0.25,
        "headings.level_5.description": "Indented, Roman, Sentence Case, Period.",
        "running_head.content": "",
        "running_head.font_size_pt": 10.0,
        "running_head.all_caps": False,
        "references.label_bold": False,
        "references.entry_indent_type": "none",
        "references.hanging_indent_inches": 0.0,
        "references.order": "order_of_appearance",
        "references.line_spacing": 1.0,
        "references.csl_style_name": "ieee",
        "tables.number_label": "TABLE",
        "tables.number_bold": False,
        "tables.title_italic": False,
        "tables.title_below_number": False,
        "tables.note_prefix": "",
        "tables.note_italic_prefix": False,
        "figures.number_label": "Fig.",
        "figures.number_bold": False,
        "figures.number_italic": False,
        "figures.title_italic": False,
        "figures.note_prefix": "",
        "figures.note_italic_prefix": False,
        "in_text_citations.style": "numeric",
        "in_text_citations.parenthetical_format": "[1]",
        "in_text_citations.narrative_format": "[1]",
        "in_text_citations.et_al_threshold": 7,
        "in_text_citations.ampersand_in_parenthetical": False,
        "in_text_citations.and_in_narrative": False,
    },
    "mla": {
        "style_name": "MLA 9th Edition",
        "style_id": "mla",
        "csl_style": "modern-language-association",
        "title_page.required": False,
        "title_page.title.bold": False,
        "title_page.title.position": "centered after header block, not bold",
        "title_page.author_name.alignment": "left",
        "title_page.author_name.position": "top-left header block: name, instructor, course, date",
        "title_page.affiliation.alignment": "left",
        "title_page.course_info.alignment": "left",
        "title_page.instructor.alignment": "left",
        "title_page.date.alignment": "left",
        "abstract.label": "",
        "abstract.label_bold": False,
        "abstract.label_alignment": "left",
        "abstract.max_words": 0,
        "abstract.keywords_label": "",
        "abstract.keywords_italic": False,
        "abstract.keywords_indent": False,
        "headings.level_1.description": "Centered, Bold, Title Case (optional section headings)",
        "headings.level_4.alignment": "left",
        "headings.level_4.bold": False,
        "headings.level_4.italic": True,
        "headings.level_4.standalone_line": True,
        "headings.level_4.ends_with_period": False,
        "headings.level_4.description": "Flush Left, Italic, Title Case",
        "headings.level_5.alignment": "left",
        "headings.level_5.bold": False,
        "headings.level_5.italic": False,
        "headings.level_5.standalone_line": True,
        "headings.level_5.description": "Flush Left, No Formatting, Title Case, Period.",
        "running_head.enabled": True,
        "running_head.content": "LAST_NAME",
        "running_head.alignment": "right",
        "running_head.all_caps": False,
        "references.section_label": "Works Cited",
        "references.csl_style_name": "modern-language-association",
        "tables.number_bold": False,
        "tables.title_italic": False,
        "tables.note_prefix": "Source:",
        "tables.note_italic_prefix": False,
        "figures.number_label": "Fig.",
        "figures.number_bold": False,
        "figures.number_italic": False,
        "figures.title_italic": False,
        "figures.note_prefix": "Source:",
        "figures.note_italic_prefix": False,
        "in_text_citations.parenthetical_format": "(Author Page)",
        "in_text_citations.narrative_format": "Author (Page)",
        "in_text_citations.ampersand_in_parenthetical": False,
    },
    "chicago": {
        "style_name": "Chicago 17th Edition (Notes-Bibliography)",
        "style_id": "chicago",
        "csl_style": "chicago-note-bibliography",
        "title_page.title.position": "approximately one-third down from top",
        "title_page.author_name.position": "below the title, centered",
        "title_page.date.position": "near bottom of title page",
        "abstract.max_words": 300,
        "headings.level_2.alignment": "center",
        "headings.level_2.bold": False,
        "headings.level_2.italic": True,
        "headings.level_2.description": "Centered, Italic, Title Case",
        "headings.level_3.italic": False,
        "headings.level_3.description": "Flush Left, Bold, Title Case",
        "headings.level_4.alignment": "left",
        "headings.level_4.bold": False,
        "headings.level_4.italic": True,
        "headings.level_4.case": "sentence_case",
        "headings.level_4.standalone_line": True,
        "headings.level_4.ends_with_period": False,
        "headings.level_4.description": "Flush Left, Italic, Sentence Case",
        "headings.level_5.alignment": "left",
        "headings.level_5.bold": False,
        "headings.level_5.italic": False,
        "headings.level_5.case": "sentence_case",
        "headings.level_5.description": "Run-in, Regular, Sentence Case, Period.",
        "running_head.content": "",
        "running_head.alignment": "right",
        "running_head.all_caps": False,
        "references.section_label": "Bibliography",
        "references.csl_style_name": "chicago-note-bibliography",
        "tables.number_bold": False,
        "tables.note_prefix": "Source:",
        "figures.number_bold": False,
        "figures.note_prefix": "Source:",
        "in_text_citations.style": "note",
        "in_text_citations.parenthetical_format": "Footnote/Endnote",
        "in_text_citations.narrative_format": "Footnote/Endnote",
        "in_text_citations.et_al_threshold": 4,
        "in_text_citations.ampersand_in_parenthetical": False,
    },
}


def _nested(leaves: dict) -> dict:
    root: dict = {}
    for path, value in leaves.items():
        *parents, leaf = path.split(".")
        node = root
        for name in parents:
            node = node.setdefault(name, {})
        node[leaf] = value
    return root


STYLE_DOCUMENTS = [json.dumps(_nested(leaves)) for leaves in STYLES.values()]
