"""Rules and chains that come with the library."""
