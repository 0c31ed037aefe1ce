"""colloquy.operators"""
