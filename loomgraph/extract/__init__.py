"""From the text of a legal unit to an outline, to typed statements, and to decisions that are replayed."""
