"""Result tables and files."""
