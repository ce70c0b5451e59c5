"""Views, registered queries and their equivalents in SQL."""
